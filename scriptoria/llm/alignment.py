"""Alignment of two tokenizers' tokens by sparse incidence products.

Tokens of both tokenizers are byte ranges of one string.  With the incidence
matrices A (tokens of the first x bytes) and B (tokens of the second x bytes),
the entries of A Bᵀ are the pairs of tokens that overlap, with the number of
bytes they share.  Bytes where tokens of both end cut the string into groups;
with tokens x groups in place of bytes, the product's entries are the pairs of
tokens that share a group.  Taken over ids in place of tokens it gives, for
each document, its pairs of ids and how often each is linked.  All matrices are
built by hand in compressed rows over a slice of documents and multiplied row
by row, in blocks of bounded size.

Each text is encoded once.  A slice stores its documents with their pairs as
positions in the slice's own list of pairs, and that list; documents are
counted over these lists, so a pair that stands in every document travels once
for each slice.  The counts come back to the slice and meet its documents in
order.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptoria.llm.csr import Csr, from_entries, product_blocks, transposed
from scriptoria.llm.rows import _arrow_schema, byte_texts, column_of, record, slices, stored, table

BYTE_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
# Characters that are encoded at a time; a longer text is cut where neither tokenizer can join what is cut.
PIECE_CHARS = 1 << 17
# An id of the second tokenizer in a pair's key.
ID_BITS = 24

_SAFE = re.compile(r"(?<=\w) (?=\w)")


def ship(spark: SparkSession, path: str) -> str:
    """Send a tokenizer's file to the executors; the name under which tasks find it."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def pieces(text: str, most: int = PIECE_CHARS) -> list[str]:
    """Cut before single blanks between word characters, at the first one after ``most`` characters.

    Such a blank begins a token of both tokenizers: the one splits before it,
    and no piece of the other has a blank behind another character.
    """
    out, at = [], 0
    while len(text) - at > most and (cut := _SAFE.search(text, at + most)):
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def byte_level_alphabet() -> dict[str, int]:
    """The characters that stand for bytes: printable ones for themselves, the others numbered from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


# How byte-level text is split before pairs are merged: a fixed value of this kind of tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteTokens:
    """Byte-level tokens of blank + text; strings of special tokens are plain text.

    The vocabulary is read from the tokenizer's file, where ids follow the order
    of the merges, so they are the ranks of an encoder that works some four
    times as fast on them; tests compare both.
    """

    def __init__(self, path: str):
        from tiktoken import Encoding

        alphabet = byte_level_alphabet()
        with open(path, encoding="utf-8") as file:
            names = json.load(file)["model"]["vocab"]
        ranks = {bytes(alphabet[c] for c in name): k for name, k in names.items()}
        self.encoding = Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            self.bytes[k] = token

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(t) for t in texts]


class PieceTokens:
    """Pieces of text, to which the model adds a blank; bytes in place of rare characters."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(name[3:5], 16)]) if self.model.is_byte(k) else name.replace("▁", " ").encode() for k, name in enumerate(names)]
        # Where a piece held a blank behind another character, cutting before a blank could part it.
        self.cuts = not any(re.search("[^▁]▁", name) for name in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@dataclass
class Tokens:
    """Ids of the documents of a slice, one after the other, and where each document's end."""

    ids: np.ndarray
    ends: np.ndarray


class Encoder:
    """Both tokenizers, and decimal ids for the digests."""

    def __init__(self, byte_path: str, piece_path: str, piece_chars: int = PIECE_CHARS):
        self.a, self.b, self.most = ByteTokens(byte_path), PieceTokens(piece_path), piece_chars
        self.lengths = [np.array([len(x) for x in t.bytes], dtype=np.int64) for t in (self.a, self.b)]
        size = max(len(self.a.bytes), len(self.b.bytes))
        # Decimal ids with what follows them: 3 * id + place of the sign.
        self.decimals = [b"%d%s" % (k, s) for k in range(size) for s in (b",", b"|", b";")]

    def __call__(self, texts: list[bytes | None]) -> tuple[Tokens, Tokens]:
        """Tokens of each text; none where the text is null or empty or either tokenizer's bytes are not blank + text."""
        ids: tuple[list, list] = ([], [])
        for wanted, found in zip(texts, self._encoded(texts)):
            whole = b" " + wanted if wanted else b""
            own = [np.array(f, dtype=np.int32) for f in found]
            # Byte-level tokens leave out or change no byte, so their length tells.
            right = int(self.lengths[0][own[0]].sum()) == len(whole) and b"".join(map(self.b.bytes.__getitem__, found[1])) == whole
            for side, tokens in zip(ids, own):
                side.append(tokens if right else tokens[:0])
        return tuple(Tokens(np.concatenate([*side, np.zeros(0, np.int32)]), np.cumsum([len(x) for x in side], dtype=np.int64)) for side in ids)

    def _encoded(self, texts: list[bytes | None]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of both tokenizers for each text, encoded by some ``most`` characters at a time."""
        waiting: list[list[str]] = []
        size = 0
        for text in texts:
            plain = text.decode("utf-8", "replace") if text else ""
            waiting.append(pieces(plain, self.most) if self.b.cuts else [plain])
            size += len(plain)
            if size >= self.most:
                yield from self._joined(waiting)
                waiting, size = [], 0
        yield from self._joined(waiting)

    def _joined(self, waiting: list[list[str]]) -> Iterator[tuple[list[int], list[int]]]:
        firsts = [own[0] for own in waiting]
        for own, a, b in zip(waiting, self.a.encode([" " + p for p in firsts]), self.b.encode(firsts)):
            for further in own[1:]:  # begins with its own blank
                a += self.a.encode([further])[0]
                b += self.b.encode([further[1:]])[0]
            yield a, b


@dataclass
class Groups:
    """Groups of a slice's tokens: the group of each token, and the groups of each document."""

    of_a: np.ndarray
    of_b: np.ndarray
    n: int
    ends: np.ndarray


def token_groups(a: Tokens, b: Tokens, a_lengths: np.ndarray, b_lengths: np.ndarray) -> Groups:
    """Cut where tokens of both end; documents end there, too."""
    a_ends, b_ends = np.cumsum(a_lengths[a.ids]), np.cumsum(b_lengths[b.ids])
    marks = np.zeros(2 + (int(a_ends[-1]) if len(a_ends) else 0), dtype=np.int8)
    marks[a_ends] += 1
    marks[b_ends] += 1
    shared_a, shared_b = marks[a_ends] == 2, marks[b_ends] == 2
    until = np.append(0, np.cumsum(shared_a))
    return Groups(until[:-1], np.cumsum(shared_b) - shared_b, int(until[-1]), until[a.ends])


def overlap_links(a: Tokens, b: Tokens, a_lengths: np.ndarray, b_lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(token of a, token of b, bytes they share): entries of the product of token-byte incidences."""
    sides = []
    for t, lengths in ((a, a_lengths), (b, b_lengths)):
        ends = np.append(0, np.cumsum(lengths[t.ids]))
        sides.append(Csr(ends, np.arange(ends[-1]), np.ones(ends[-1], np.int64), int(ends[-1])))
    return product_blocks(sides[0], transposed(sides[1]))


def group_links(groups: Groups) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(token of a, token of b, 1): entries of the product of token-group incidences."""
    a, b = (from_entries(np.arange(len(g)), g, len(g), groups.n) for g in (groups.of_a, groups.of_b))
    return product_blocks(a, transposed(b))


def id_links(a: Tokens, b: Tokens, groups: Groups, sizes: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, id of a, id of b, links) of each document's linked pairs of ids, in order.

    Rows of the left side are the ids that occur in a document, so a pair that
    is linked in many groups of it is one entry.
    """
    doc = np.repeat(np.arange(len(a.ends)), np.diff(np.append(0, a.ends)))
    own, row = np.unique(doc * sizes[0] + a.ids, return_inverse=True)
    left = from_entries(row, groups.of_a, len(own), groups.n)
    right = from_entries(groups.of_b, b.ids, groups.n, sizes[1])
    for rows, columns, links in product_blocks(left, right):
        yield own[rows] // sizes[0], own[rows] % sizes[0], columns, links


def group_digests(a: Tokens, b: Tokens, groups: Groups, decimals: list[bytes]) -> list[str]:
    """For each document SHA-256 of ``a1,a2|b1;a3|b2,b3``: the ids of each group, in order; '' without tokens."""
    keys = np.zeros(len(a.ids) + len(b.ids), dtype=np.int64)
    # Before a token of a stand the tokens of b of earlier groups, before one of b those of a up to its group.
    n_a, n_b = (np.append(0, np.cumsum(np.bincount(g, minlength=groups.n))) for g in (groups.of_a, groups.of_b))
    for t, of, other, closing in ((a, groups.of_a, n_b[:-1], 1), (b, groups.of_b, n_a[1:], 2)):
        last = np.append(of[1:] != of[:-1], True)[: len(of)]
        keys[np.arange(len(of)) + other[of]] = 3 * t.ids.astype(np.int64) + closing * last
    cuts = np.append(0, a.ends + b.ends).tolist()
    parts = keys.tolist()
    return [hashlib.sha256(b"".join(map(decimals.__getitem__, parts[i:j]))[:-1]).hexdigest() if i < j else "" for i, j in zip(cuts, cuts[1:])]


_LINKED = (
    "slice bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_overlaps bigint, groups_sha256 string,"
    " pairs array<int>, links array<bigint>, keys array<bigint>, docs array<bigint>"
)


@functools.cache
def _encoder(byte_name: str, piece_name: str) -> Encoder:
    return Encoder(SparkFiles.get(byte_name), SparkFiles.get(piece_name))


def align_slice(texts: list[bytes | None], encoder: Encoder) -> tuple[dict, np.ndarray, np.ndarray]:
    """Columns of the documents, and the slice's pair keys with the number of documents that hold each."""
    a, b = encoder(texts)
    groups = token_groups(a, b, *encoder.lengths)
    n_docs, overlaps, per_doc = len(texts), np.zeros(len(a.ids), np.int64), []
    for rows, _, _ in overlap_links(a, b, *encoder.lengths):
        overlaps[rows[0] : rows[-1] + 1] += np.bincount(rows - rows[0])
    for doc, x, y, links in id_links(a, b, groups, tuple(map(len, encoder.lengths))):
        per_doc.append((doc, (x << ID_BITS) | y, links))
    doc, key, links = (np.concatenate(c) for c in zip(*per_doc)) if per_doc else (np.zeros(0, np.int64),) * 3
    keys, at, docs = np.unique(key, return_inverse=True, return_counts=True)
    cuts = np.searchsorted(doc, np.arange(1, n_docs))
    sums = np.append(0, np.cumsum(overlaps))
    return {
        "n_a": np.diff(np.append(0, a.ends)), "n_b": np.diff(np.append(0, b.ends)), "n_groups": np.diff(np.append(0, groups.ends)),
        "n_links": np.bincount(doc, links, minlength=n_docs).astype(np.int64), "n_overlaps": np.diff(np.append(0, sums[a.ends])),
        "groups_sha256": group_digests(a, b, groups, encoder.decimals), "pairs": np.split(at.astype(np.int32), cuts), "links": np.split(links, cuts),
    }, keys, docs


def linked_documents(documents: DataFrame, byte_tokenizer: str = BYTE_TOKENIZER, piece_tokenizer: str = PIECE_TOKENIZER) -> DataFrame:
    """Rows of documents with their pairs as positions, and for each slice one row with its pairs (keys, docs)."""
    names = [ship(documents.sparkSession, p) for p in (byte_tokenizer, piece_tokenizer)]
    kinds = _arrow_schema(documents.sparkSession, _LINKED)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch):
                n = part.num_rows
                columns, keys, docs = align_slice(byte_texts(part), _encoder(*names))
                nothing: list = [None] * n
                yield record({"slice": [number] * n, "doc_id": column_of(part, "doc_id"), **columns, "keys": nothing, "docs": nothing}, kinds)
                alone = {f.name: [None] for f in kinds}
                yield record(alone | {"slice": [number], "keys": [keys], "docs": [docs]}, kinds)
                number += 1

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _LINKED)


def pair_counts(linked: DataFrame) -> DataFrame:
    """(key, count, best): in how many documents a pair of ids is linked, and whether no pair of its first id has more.

    An id has at most as many pairs as the other tokenizer has ids, which bounds a window's rows.
    """
    listed = linked.where("keys IS NOT NULL").select(F.explode(F.arrays_zip("keys", "docs")).alias("z"))
    counts = listed.groupBy(F.col("z.keys").alias("key")).agg(F.sum("z.docs").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.shiftright("key", ID_BITS)))
    return counts.select("key", "count", (F.col("count") == most).alias("best"))


_OUT = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, n_overlaps bigint"
)


def align_tokens(documents: DataFrame, byte_tokenizer: str = BYTE_TOKENIZER, piece_tokenizer: str = PIECE_TOKENIZER) -> DataFrame:
    """One row for each row of ``documents`` (doc_id, text): counts of tokens, groups and links, and the groups' digest.

    ``n_links`` counts pairs of tokens that share a group, ``n_best`` those
    whose pair of ids stands linked in as many rows of the corpus as any pair
    of its first id (ties included), ``count_sum`` adds these rows over the
    links, ``n_overlaps`` counts pairs of tokens that share a byte.  A null or
    empty text, or one that either tokenizer doesn't give back byte by byte,
    has no tokens: zeros, and '' for ``groups_sha256``.  Repeated rows and ids
    count each.  Texts of any length are whole; they are encoded in pieces
    that meet between tokens.  An empty table gives no rows; other columns are
    not read.
    """
    linked = stored(linked_documents(documents, byte_tokenizer, piece_tokenizer))
    own = linked.where("keys IS NOT NULL").select("slice", F.posexplode("keys").alias("place", "key"))
    found = own.join(pair_counts(linked), "key").groupBy("slice").agg(F.collect_list(F.struct("place", "count", "best")).alias("known"))
    docs = linked.where("keys IS NULL").drop("keys", "docs")
    both = docs.withColumn("known", F.lit(None).cast(found.schema["known"].dataType)).unionByName(found, allowMissingColumns=True)
    kinds = _arrow_schema(documents.sparkSession, _OUT)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, count, best = None, np.zeros(0, np.int64), np.zeros(0, bool)
        for batch in batches:
            numbers, known, pairs, links = (column_of(batch, c) for c in ("slice", "known", "pairs", "links"))
            keep, sums, bests = [], [], []
            for k in range(batch.num_rows):
                if known[k].is_valid:
                    place, counts, bests_of = (f.to_numpy(zero_copy_only=False) for f in known[k].values.flatten())
                    order = np.argsort(place)
                    at, count, best = numbers[k].as_py(), counts[order], bests_of[order].astype(bool)
                    continue
                p, n = (c[k].values.to_numpy(zero_copy_only=False) for c in (pairs, links))
                if len(p) and numbers[k].as_py() != at:
                    raise RuntimeError("a slice without its counts")
                keep.append(k)
                sums.append(int((count[p] * n).sum()) if len(p) else 0)
                bests.append(int(n[best[p]].sum()) if len(p) else 0)
            if keep:
                taken = batch.take(pa.array(keep))
                own = {n: column_of(taken, n) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_overlaps")}
                values = own | {"n_best": bests, "count_sum": sums}
                yield record({f.name: values[f.name] for f in kinds}, kinds)

    # The row with a slice's counts comes before its documents.
    rows = both.repartition("slice").sortWithinPartitions("slice", F.col("known").isNull())
    return rows.mapInArrow(run, _OUT)


def op13_tokenizer_alignment(spark, sf_dir):
    return align_tokens(table(spark, sf_dir, "documents"))
