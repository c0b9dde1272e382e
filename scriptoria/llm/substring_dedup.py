"""Removal of repeated passages, found by recompression.

A window is a fixed number of consecutive words.  A word goes if a window that
covers it also starts in a document with a smaller id.  Exchanging all windows
would move the corpus many times over, so the symbols of a recompression
(``recompression.py``) decide which windows can repeat at all:

1. Every document is recompressed.  A window is tested by the symbols whose
   reach lies inside it: those of three words or more, else those of two, else
   the window itself.  The same window has the same tests wherever it stands,
   so it can repeat only if all its tests stand in a second document.
2. The windows that pass are exchanged under 80 bits of a fingerprint of all
   their words, and the smallest id of each is looked up.
3. Documents that hold a covered window lose the words under it.

A document whose whole word sequence stands in a document with a smaller id
takes no part; it loses all its words if it has a window.  Passages and lines
that very many documents share are combined before an exchange: in each slice
of rows only one document speaks for a test, and a window that a document of
the slice with a smaller id holds is covered without an exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.llm.recompression import Numbers, Symbols, mixed, recompress
from scriptoria.llm.rows import byte_texts, column_of, map_slices, table
from scriptoria.session import cut_lineage

WINDOW_WORDS = 13
_POWERS = np.array([0x9DDFEA08EB382D69, 0xE7037ED1A0B428DB], dtype=np.uint64)


class Slice:
    """Words, windows and tests of some documents in one row of words, a wall after each document."""

    def __init__(self, texts: list[bytes | None], numbers: Numbers, window: int):
        words, lengths = [], []
        self.words = [t.split() if t else [] for t in texts]
        for own in self.words:
            words += own
            words.append(b" ")
            lengths.append(len(own) + 1)
        self.window, n = window, len(words)
        self.lengths = np.array(lengths, dtype=np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.wall = np.zeros(n, dtype=bool)
        self.wall[self.first + self.lengths - 1] = True
        self.doc = np.repeat(np.arange(len(texts)), self.lengths)
        self.numbers = numbers(words)
        walls = np.append(0, np.cumsum(self.wall))
        # Windows that hold no wall, by their first word.
        self.valid = np.zeros(n + 1, dtype=bool)
        if n >= window:
            self.valid[: n - window + 1] = walls[window:] == walls[: n - window + 1]
        symbols = recompress(np.ascontiguousarray(self.numbers[:, 0]), self.wall)
        inside = (symbols.low >= 0) & (symbols.high <= n) & (symbols.high - symbols.low <= window) & (symbols.end - symbols.start >= 2)
        s = Symbols(*(getattr(symbols, f)[inside] for f in ("name", "start", "end", "low", "high")))
        inside = walls[s.high] == walls[s.low]
        self.symbols = Symbols(*(getattr(s, f)[inside] for f in ("name", "start", "end", "low", "high")))
        # A symbol tests the windows [since, until] that hold its reach.
        self.since, self.until = np.maximum(self.symbols.high - window, 0), self.symbols.low
        self.long = self.symbols.end - self.symbols.start >= 3

    def _cover(self, which: np.ndarray) -> np.ndarray:
        size = len(self.valid) + 1
        return np.cumsum(np.bincount(self.since[which], minlength=size) - np.bincount(self.until[which] + 1, minlength=size))[:-1]

    def fingerprints(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """80 bits of each window that starts at ``at``."""
        out = []
        for k in range(2):
            total = np.zeros(len(at), dtype=np.uint64)
            for j in range(self.window):
                total = total * _POWERS[k] + self.numbers[at + j, k]
            out.append(mixed(total))
        return out[0].astype(np.int64), (out[1] >> np.uint64(48)).astype(np.int64).astype(np.int16)

    def tests(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, test) of all windows, each once."""
        by_long = self._cover(self.long) > 0
        by_any = self._cover(np.ones(len(self.long), dtype=bool)) > 0
        alone = np.flatnonzero(self.valid & ~by_any)
        # A symbol is wanted if one of its windows is decided by symbols of its kind.
        wanted = []
        for kind, windows in ((self.long, self.valid), (~self.long, self.valid & ~by_long)):
            before = np.append(0, np.cumsum(windows))
            wanted.append(kind & (before[self.until + 1] > before[self.since]))
        use = wanted[0] | wanted[1]
        names = np.concatenate([self.symbols.name[use].astype(np.int64), self.fingerprints(alone)[0]])
        docs = np.concatenate([self.doc[self.symbols.start[use]], self.doc[alone]])
        order = np.lexsort((names, docs))
        docs, names = docs[order], names[order]
        new = np.ones(len(docs), dtype=bool)
        new[1:] = (docs[1:] != docs[:-1]) | (names[1:] != names[:-1])
        return docs[new], names[new]

    def candidates(self, docs: np.ndarray, tests: np.ndarray) -> np.ndarray:
        """Windows all of whose tests are among (document, test)."""
        with np.errstate(over="ignore"):
            code = lambda d, t: mixed(t.astype(np.uint64) ^ mixed(d.astype(np.uint64) + np.uint64(1)))
            known = np.isin(code(self.doc[self.symbols.start], self.symbols.name), code(docs, tests))
            every = np.ones(len(self.long), dtype=bool)
            by_long, by_any = self._cover(self.long) > 0, self._cover(every) > 0
            fails = np.where(by_long, self._cover(self.long & ~known), self._cover(~known)) > 0
            alone = np.flatnonzero(self.valid & ~by_any)
            fails[alone] = ~np.isin(code(self.doc[alone], self.fingerprints(alone)[0]), code(docs, tests))
        return np.flatnonzero(self.valid & ~fails)


def _sequence(words: list[bytes]) -> np.ndarray:
    """128 bits that stand for a document's word sequence, as two numbers."""
    return np.frombuffer(hashlib.blake2b(b" ".join(words), digest_size=16).digest(), np.int64)


_TESTED = "doc_id bigint, s1 bigint, s2 bigint, alone array<bigint>, spoken array<bigint>, known array<bigint>"


def _recompressed(documents: DataFrame, window: int) -> DataFrame:
    """Tests of each document: ``known`` are in a second document of the slice, ``spoken`` are those it speaks for, ``alone`` the others."""
    numbers = Numbers()

    def run(batch: pa.RecordBatch) -> dict:
        ids = column_of(batch, "doc_id").to_pylist()
        texts = byte_texts(batch)
        slice_ = Slice(texts, numbers, window)
        sequences = np.array([_sequence(w) for w in slice_.words]).reshape(-1, 2)
        # Of equal word sequences only the one with the smallest id can matter.
        best: dict[tuple, tuple] = {}
        for k, (d, i) in enumerate(zip(map(tuple, sequences.tolist()), ids)):
            if i is not None:
                best[d] = min(best.get(d, (i, k)), (i, k))
        counts = np.zeros(len(ids), dtype=bool)
        counts[[k for _, k in best.values()]] = True
        docs, tests = slice_.tests()
        docs, tests = docs[counts[docs]], tests[counts[docs]]
        _, place, inverse, many = np.unique(tests, return_index=True, return_inverse=True, return_counts=True)
        shared = many[inverse] > 1
        speaks = np.zeros(len(tests), dtype=bool)
        speaks[place] = True
        lists = [_lists(docs, tests, mask, len(ids)) for mask in (~shared, shared & speaks, shared)]
        return {"doc_id": ids, "s1": sequences[:, 0], "s2": sequences[:, 1], "alone": lists[0], "spoken": lists[1], "known": lists[2]}

    return map_slices(documents, _TESTED, run)


def _lists(docs: np.ndarray, values: np.ndarray, mask: np.ndarray, n: int) -> pa.Array:
    """``values`` under ``mask`` as one list for each of ``n`` documents; ``docs`` is sorted."""
    ends = np.searchsorted(docs[mask], np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[mask], pa.int64()))


_WINDOWS = "k1 bigint, k2 smallint, doc_id bigint, place bigint"
# Bits of a place that count words; above them stands which of the texts of a repeated doc_id it is.
_PLACE_BITS = 40


def _turn(twins: list[int] | None, words: list[bytes]) -> int:
    """Which of the different texts under one doc_id this is; 0 where there is but one."""
    return sorted(twins).index(int(_sequence(words)[0])) if twins else 0


def _candidate_windows(rows: DataFrame, window: int) -> DataFrame:
    """Windows that may repeat; the place is -1 - place where a document of the slice with a smaller id holds it too."""
    numbers = Numbers()

    def run(batch: pa.RecordBatch) -> dict | None:
        batch = batch.filter(column_of(batch, "tests").is_valid())
        slice_ = Slice(byte_texts(batch), numbers, window)
        lists = column_of(batch, "tests").to_pylist()
        docs = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        at = slice_.candidates(docs, np.array([t for x in lists for t in x], dtype=np.int64))
        if not len(at):
            return None
        turns = np.array([_turn(t, w) for t, w in zip(column_of(batch, "twins").to_pylist(), slice_.words)], dtype=np.int64)
        k1, k2 = slice_.fingerprints(at)
        doc = slice_.doc[at]
        owner, place = column_of(batch, "doc_id").to_numpy()[doc], (turns[doc] << _PLACE_BITS) | (at - slice_.first[doc])
        # The first row of a window is that of the smallest id; it goes on, and so does any tie.
        order = np.lexsort((owner, k2, k1))
        k1, k2, owner, place = k1[order], k2[order], owner[order], place[order]
        new = np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))
        covered = owner > owner[np.flatnonzero(new)][np.cumsum(new) - 1]
        # What needs no look-up takes a key of its own, lest it crowd the key of its window.
        k1 = np.where(covered, mixed((owner ^ (place << 20)).astype(np.uint64)).astype(np.int64), k1)
        return {"k1": k1, "k2": k2, "doc_id": owner, "place": np.where(covered, -1 - place, place)}

    return map_slices(rows, _WINDOWS, run)


_KEPT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"


def _without_repeats(rows: DataFrame, window: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        out = {name: [] for name in ("n_words", "n_removed", "kept_sha256", "kept_text")}
        for text, places, copies, twins in zip(byte_texts(batch), *(column_of(batch, c).to_pylist() for c in ("places", "copies", "twins"))):
            words = text.split() if text else []
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            if copies and len(words) >= window and int(_sequence(words)[0]) in copies:
                gone[0], gone[-1] = 1, -1
            elif places:
                at, turn = np.array(places, dtype=np.int64), _turn(twins, words)
                at = at[at >> _PLACE_BITS == turn] & ((1 << _PLACE_BITS) - 1)
                np.add.at(gone, at, 1)
                np.add.at(gone, at + window, -1)
            kept = np.cumsum(gone)[:-1] == 0
            left = words if kept.all() else [w for w, k in zip(words, kept.tolist()) if k]
            joined = b" ".join(left)
            for name, value in zip(out, (len(words), len(words) - len(left), hashlib.sha256(joined).hexdigest(), joined)):
                out[name].append(value)
        out["kept_text"] = pa.array(out["kept_text"], pa.binary()).cast(pa.string())
        return {"doc_id": column_of(batch, "doc_id"), **out}

    return map_slices(rows, _KEPT, run)


def remove_repeats(documents: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """One row for each row of ``documents`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256, kept_text.

    Words are the runs between blanks (space, tab, line ends); ``kept_text``
    joins the kept ones with one space.  Windows are those of the input.  A
    null text has no words.  A document without id is never earlier than
    another and loses nothing.  Rows that repeat a doc_id do not count as
    earlier than each other.  Other columns are not read; an empty table gives
    no rows.
    """
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tested = cut_lineage(_recompressed(texts, window))
    ids = tested.select("doc_id", "s1", "s2")
    first = ids.groupBy("s1", "s2").agg(F.min("doc_id").alias("least"))
    copies = cut_lineage(ids.join(first, ["s1", "s2"]).where("doc_id > least").select("doc_id", "s1"))
    own = tested.join(_broadcast_if_small(copies), ["doc_id", "s1"], "left_anti")
    nothing = F.lit(None).cast("bigint")
    # Of two documents of one slice that share a test, one spoke; it may be a copy, so all that was spoken counts.
    said = own.select(F.explode("alone").alias("test"), "doc_id").unionByName(tested.select(F.explode("spoken").alias("test"), nothing.alias("doc_id")))
    heard = said.withColumn("_n", F.sum(F.when(F.col("doc_id").isNull(), 2).otherwise(1)).over(Window.partitionBy("test")))
    passed = heard.where("_n > 1 AND doc_id IS NOT NULL").select("doc_id", "test").unionByName(own.select("doc_id", F.explode("known").alias("test")))
    # Different texts under one doc_id.
    repeated = ids.groupBy("doc_id").agg(F.min("s1").alias("a"), F.max("s1").alias("z")).where("a <> z").select("doc_id")
    twins = ids.join(repeated, "doc_id", "left_semi").select("doc_id", F.col("s1").alias("twin")).distinct()
    marks = (
        passed.withColumn("twin", nothing).unionByName(twins.withColumn("test", nothing))
        .groupBy("doc_id").agg(F.collect_set("test").alias("tests"), F.collect_set("twin").alias("twins"))
    )
    # Both joins keep all texts, so Spark exchanges the texts once for the two of them.
    windows = _candidate_windows(texts.join(marks, "doc_id", "left"), window)
    least = F.min("doc_id").over(Window.partitionBy("k1", "k2"))
    places = windows.withColumn("_least", least).where("place < 0 OR doc_id > _least")
    places = places.select("doc_id", F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("place"))
    columns = ["place", "copy", "twin"]
    wide = lambda df: df.select("doc_id", *(F.col(c) if c in df.columns else nothing.alias(c) for c in columns))
    gone = wide(places).unionByName(wide(copies.withColumnRenamed("s1", "copy"))).unionByName(wide(twins))
    gone = gone.groupBy("doc_id").agg(F.collect_set("place").alias("places"), F.collect_set("copy").alias("copies"), F.collect_set("twin").alias("twins"))
    return _without_repeats(texts.join(gone, "doc_id", "left"), window)


# Rows of two numbers that may be broadcast: some 64 MB.
_BROADCAST_ROWS = 2_000_000


def _broadcast_if_small(df: DataFrame) -> DataFrame:
    """A hint behind a count of the stored rows; beyond the bound Spark shuffles the join."""
    return F.broadcast(df) if df.count() <= _BROADCAST_ROWS else df


def op2_substring_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


OP2_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (
  SELECT doc_id, p, md5(array_to_string(w[p:p + {WINDOW_WORDS - 1}], ' ')) AS k FROM d, unnest(range(1, len(w) - {WINDOW_WORDS - 2})) AS r(p)),
least AS (SELECT k, min(doc_id) AS first_id FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + {WINDOW_WORDS})) AS p FROM win JOIN least USING (k) WHERE doc_id > first_id),
lost AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lost ON lost.doc_id = d.doc_id"""
