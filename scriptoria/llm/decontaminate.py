"""Benchmark decontamination with the Wu-Manber multi-pattern search over words.

A benchmark item gives its windows of ten words, or itself if it is shorter.
For the windows of one length m, a shift table maps each block of two words to
the distance of its last place from the window's end; a block that no window
holds skips m - 1 words at once.  A block that ends a window selects a bucket,
its windows are told apart by their first two words, and what is left is
compared word by word.

The tables of one block of benchmark rows go to the tasks with the function;
their size is bounded by ``block_words``.  A larger benchmark is searched block
after block; the hits found so far travel with the rows, and each pass is
stored, so no task ever holds the tables of two blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.rows import byte_texts, column_of, map_slices, table
from scriptoria.session import cut_lineage

WINDOW_WORDS = 10
# Words of benchmark text whose windows make the tables of one pass.
BLOCK_WORDS = 200_000

# Bytes that no word holds become blanks: all of ASCII but digits and letters.
_BLANKS = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words after lower-casing A-Z: runs of digits, a-z and characters beyond ASCII."""
    return text.lower().translate(_BLANKS).split() if text else []


class Tables:
    """Shift, bucket and prefix tables of all windows of one length."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list[tuple[tuple, list[int]]]]] = {}

    def add(self, window: tuple, item: int) -> None:
        m, b = self.length, self.block
        for end in range(b, m + 1):
            piece = window[end - b : end]
            self.shift[piece] = min(self.shift.get(piece, m), m - end)
        tests = self.buckets.setdefault(window[m - b :], {}).setdefault(window[:b], [])
        for other, items in tests:
            if other == window:
                if items[-1] != item:
                    items.append(item)
                return
        tests.append((window, [item]))

    def search(self, words: list[bytes]) -> Iterable[tuple[int, list[int]]]:
        """(start, items) of each occurrence."""
        m, b, shift, buckets = self.length, self.block, self.shift, self.buckets
        end, n, far = m, len(words), m - b + 1
        while end <= n:
            piece = tuple(words[end - b : end])
            step = shift.get(piece, far)
            if step:
                end += step
                continue
            start = end - m
            for window, items in buckets[piece].get(tuple(words[start : start + b]), ()):
                if all(x == y for x, y in zip(window, words[start:end])):
                    yield start, items
            end += 1


def tables_of(items: Iterable[tuple[int, bytes | None]], window_words: int = WINDOW_WORDS) -> list[Tables]:
    by_length: dict[int, Tables] = {}
    for item, text in items:
        words = words_of(text)
        m = min(window_words, len(words))
        for start in range(len(words) - m + 1 if m else 0):
            by_length.setdefault(m, Tables(m)).add(tuple(words[start : start + m]), item)
    return list(by_length.values())


def _blocks(benchmark: DataFrame, block_words: int) -> list[list[tuple]]:
    """Rows of the benchmark in blocks of about ``block_words`` words; one block at a time is in the driver's hands."""
    block, size = [], 0
    for row in benchmark.toLocalIterator():
        if not row["text"]:
            continue
        block.append((row["item_id"], row["text"].encode()))
        size += len(row["text"]) // 5 + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(
    documents: DataFrame, benchmark: DataFrame, window_words: int = WINDOW_WORDS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Add n_words, n_hit, n_items, items_sha256, items and contaminated to ``documents`` (text).

    ``benchmark`` has item_id and text.  A word inside any occurrence of a
    window is hit; ``items`` lists the ids with occurring windows as strings
    in order, ``items_sha256`` is the digest of their comma-joined list, of
    the empty string where there are none.  Null texts have no words, null
    item ids count as an empty name, repeated items as one, repeated document
    rows each get their row.  Columns of the added names are replaced.
    """
    added = ["n_words", "n_hit", "n_items", "items_sha256", "items", "contaminated"]
    own = [c for c in documents.columns if c.lower() not in added]
    rows = documents.select(
        F.struct(F.lit(0), *(F.col(f"`{c}`") for c in own if c != "text")).alias("row"), F.col("text").cast("string").alias("text"),
        F.lit(None).cast("binary").alias("spans"), F.lit(None).cast("array<string>").alias("items"),
    )
    passes = 0
    for block in _blocks(benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")), block_words):
        rows = _search_block(cut_lineage(rows) if passes else rows, block, window_words)
        passes += 1
    return _summed(rows, own)


def _search_block(rows: DataFrame, block: list[tuple], window_words: int) -> DataFrame:
    names = sorted({i or "" for i, _ in block})
    number = {n: k for k, n in enumerate(names)}
    tables = tables_of(((number[i or ""], t) for i, t in block), window_words)

    def run(batch: pa.RecordBatch) -> dict:
        spans, items = [], []
        for text, old, known in zip(byte_texts(batch), column_of(batch, "spans").to_pylist(), column_of(batch, "items").to_pylist()):
            words, found, at = words_of(text), set(known or ()), []
            for t in tables:
                for start, which in t.search(words):
                    at += (start, start + t.length)
                    found.update(names[k] for k in which)
            spans.append((old or b"") + np.array(at, dtype=np.int64).tobytes())
            items.append(sorted(found))
        return {"row": column_of(batch, "row"), "text": column_of(batch, "text"), "spans": spans, "items": items}

    return map_slices(rows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), run)


def _summed(rows: DataFrame, own: list[str]) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        n_words, n_hit, items = [], [], []
        for text, spans, found in zip(byte_texts(batch), column_of(batch, "spans").to_pylist(), column_of(batch, "items").to_pylist()):
            n = len(words_of(text))
            change = np.zeros(n + 1, dtype=np.int64)
            at = np.frombuffer(spans or b"", dtype=np.int64)
            np.add.at(change, at[0::2], 1)
            np.add.at(change, at[1::2], -1)
            n_words.append(n)
            n_hit.append(int((np.cumsum(change) > 0).sum()))
            items.append(found or [])
        return {
            "row": column_of(batch, "row"), "text": column_of(batch, "text"), "n_words": n_words, "n_hit": n_hit, "n_items": [len(i) for i in items],
            "items_sha256": [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], "items": items, "contaminated": [h > 0 for h in n_hit],
        }

    row = rows.schema["row"].dataType.simpleString()
    schema = f"row {row}, text string, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, items array<string>, contaminated boolean"
    found = map_slices(rows, schema, run)
    return found.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in own), "n_words", "n_hit", "n_items", "items_sha256", "items", "contaminated")


def op3_decontamination(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(documents, table(spark, sf_dir, "benchmark")).drop("text", "items")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, w, least({WINDOW_WORDS}, len(w)) AS m FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
wins AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM b, unnest(range(1, len(w) - m + 2)) AS r(i)),
places AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS k
  FROM d, (SELECT DISTINCT m FROM b) AS lengths, unnest(range(1, len(w) - m + 2)) AS r(i) WHERE len(w) >= m),
hits AS (SELECT doc_id, i, m, item FROM places JOIN wins USING (m, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""
