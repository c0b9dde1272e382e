"""Exact de-duplication by composable polynomial fingerprints.

The text of a document, A-Z lower-cased, is cut into chunks of bytes.  Each
chunk gets a polynomial hash modulo two primes, and the hashes of neighbours
combine by length-shifted arithmetic, ``H(xy) = H(x) * B^|y| + H(y)``, so the
fingerprint of a document of any length comes from independent chunk hashes.
Documents that share length and fingerprint are compared, chunk by chunk, as a
stream of rows that holds one text of each class in memory.

A group may hold a third of all rows.  Its rows are spread over as many
partitions as its size asks for; each partition compares its rows with the
first one it has seen, and passes one text of each class on.  These texts are
spread and compared in the same way, round by round, until the largest group
fits one partition, so no task ever compares more than about ``GROUP_ROWS``
texts of a group whose members are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.rows import byte_texts, column_of, map_slices, stored

CHUNK_BYTES = 4096
PRIMES = (2_147_483_647, 2_147_483_629)
BASE = 1_000_003
# Rows of one group that one partition compares.
GROUP_ROWS = 1000

_KEY = ["n_bytes", "f1", "f2"]


def combine(left: int, right: int, right_bytes: int, prime: int) -> int:
    """The hash of two neighbouring pieces from the hashes of the pieces."""
    return (left * pow(BASE, right_bytes, prime) + right) % prime


class Fingerprint:
    """Fingerprints of byte strings: chunk hashes as one matrix product, then combined."""

    def __init__(self, primes: tuple[int, ...] = PRIMES, chunk_bytes: int = CHUNK_BYTES):
        self.primes, self.chunk = primes, chunk_bytes
        self.powers = np.array([[pow(BASE, chunk_bytes - 1 - i, p) for p in primes] for i in range(chunk_bytes)], dtype=np.int64)

    def __call__(self, text: bytes) -> list[int]:
        # Zeros in front change no hash; the length is part of the key.
        n = -(-len(text) // self.chunk)
        if n <= 1:
            codes = np.frombuffer(text, dtype=np.uint8).astype(np.int64)
            return [int(h) % p for h, p in zip(codes @ self.powers[self.chunk - len(text) :], self.primes)]
        padded = np.zeros(n * self.chunk, dtype=np.int64)
        padded[n * self.chunk - len(text) :] = np.frombuffer(text, dtype=np.uint8)
        hashes = padded.reshape(n, self.chunk) @ self.powers
        out = []
        for k, p in enumerate(self.primes):
            total, shift = 0, pow(BASE, self.chunk, p)
            for h in (hashes[:, k] % p).tolist():
                total = (total * shift + h) % p  # combine(total, h, chunk_bytes, p)
            out.append(total)
        return out


def same_bytes(a: bytes, b: bytes, chunk_bytes: int = 1 << 16) -> bool:
    """Chunkwise comparison that stops at the first chunk that differs."""
    if len(a) != len(b):
        return False
    left, right = memoryview(a), memoryview(b)
    return all(left[i : i + chunk_bytes] == right[i : i + chunk_bytes] for i in range(0, len(a), chunk_bytes))


def fingerprints(documents: DataFrame, with_text: bool, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """doc_id, n_bytes, f1, f2, text_sha256 and, if asked for, the normalised text; null counts as empty."""
    make = Fingerprint(primes)

    def run(batch: pa.RecordBatch) -> dict:
        texts = [(t or b"").lower() for t in byte_texts(batch)]
        prints = [make(t) for t in texts]
        out = {
            "doc_id": column_of(batch, "doc_id"), "n_bytes": [len(t) for t in texts],
            "f1": [f[0] for f in prints], "f2": [f[1] for f in prints],
            "text_sha256": [hashlib.sha256(t).hexdigest() for t in texts],
        }
        return out | {"text": pa.array(texts, pa.binary()).cast(pa.string())} if with_text else out

    schema = "doc_id bigint, n_bytes bigint, f1 bigint, f2 bigint, text_sha256 string" + ", text string" * with_text
    return map_slices(documents.select(F.col("doc_id").cast("bigint"), "text"), schema, run)


def _classes(df: DataFrame, group: list[str], keep: list[str], text_out: bool) -> DataFrame:
    """Number the different texts of each group; rows come sorted by group and are compared as a stream.

    With ``text_out`` the first row of each class carries its text, the others null.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*group, *keep).schema)
    fields = [*group, *keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys = list(zip(*(column_of(part, c).to_pylist() for c in group)))
                numbers, texts = [], []
                for key, text in zip(keys, byte_texts(part)):
                    if key != current:
                        current, seen = key, []
                    at_class = next((k for k, s in enumerate(seen) if same_bytes(s, text)), len(seen))
                    texts.append(text if at_class == len(seen) else None)
                    if at_class == len(seen):
                        seen.append(text)
                    numbers.append(at_class)
                arrays = [column_of(part, c) for c in fields] + [pa.array(numbers, pa.int32())]
                names = [*fields, "class"]
                if text_out:
                    arrays, names = [*arrays, pa.array(texts, pa.binary()).cast(pa.string())], [*names, "text"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    rows = df.select(*fields, "text").repartition(*group).sortWithinPartitions(*group)
    return rows.mapInArrow(run, f"{schema}, class int" + ", text string" * text_out)


def exact_duplicates(documents: DataFrame, group_rows: int = GROUP_ROWS, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """One row for each row of ``documents`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the
    largest doc_id stays.  A null text is an empty one.  Rows that repeat a
    doc_id with an equal text stand for one document: each counts in
    ``group_size`` and each has the same ``kept``.  A null doc_id stays only
    if its whole group has none.  A very long text is hashed and compared in
    pieces but is one value of a row; an empty table gives no rows.  Other
    columns are not read.
    """
    plain = stored(fingerprints(documents, False, primes))
    shared = plain.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    alone = plain.join(shared, _KEY, "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    largest = shared.agg(F.max("n")).first()[0] or 0
    # Ids may repeat, so each row draws its own place in the group; drawn on the scan, it is the same when a task is run again.
    texts = fingerprints(documents, True, primes).withColumn("draw", F.rand(7))
    rows = texts.join(shared, _KEY).withColumn("salt", F.floor(F.col("draw") * F.ceil(F.col("n") / group_rows)).cast("int"))
    local = stored(_classes(rows, [*_KEY, "salt"], ["doc_id", "text_sha256"], True))
    members = local.drop("text").withColumnRenamed("class", "leaf")
    names = _named(local.where("text IS NOT NULL").select(*_KEY, "salt", "class", "text"), -(-largest // group_rows), group_rows)
    members = members.join(names, [*_KEY, "salt", "leaf"])
    groups = members.groupBy(*_KEY, "class").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    equal = members.join(groups, [*_KEY, "class"]).select(
        "doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256"
    )
    return alone.unionByName(equal)


def _named(firsts: DataFrame, salts: int, group_rows: int) -> DataFrame:
    """(key, salt, leaf, class): the class of each (key, salt, class) of ``firsts`` among all salts of its key.

    Salts are folded ``group_rows`` (two at least) to one, round by round, until one is left.
    """
    fan = max(2, group_rows)
    names = firsts.select(*_KEY, "salt", F.col("class").alias("leaf"), F.col("salt").alias("at"), "class")
    while True:
        salts = -(-salts // fan)
        folded = firsts.withColumn("fold", F.floor(F.col("salt") / fan).cast("int")).withColumnsRenamed({"salt": "at", "class": "was"})
        found = _classes(folded, [*_KEY, "fold"], ["at", "was"], salts > 1)
        found = stored(found) if salts > 1 else found
        step = found.select(*_KEY, "at", F.col("was").alias("class"), F.col("fold").alias("next"), F.col("class").alias("named"))
        names = names.join(step, [*_KEY, "at", "class"]).select(*_KEY, "salt", "leaf", F.col("next").alias("at"), F.col("named").alias("class"))
        if salts <= 1:
            return names.select(*_KEY, "salt", "leaf", "class")
        firsts = found.where("text IS NOT NULL").select(*_KEY, F.col("fold").alias("salt"), "class", "text")


def op10_exact_dedup(spark, sf_dir):
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW g AS (PARTITION BY t)"""
