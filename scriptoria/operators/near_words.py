"""Near neighbours of words in a vocabulary, with few pairs of words compared letter by letter.

Similarity is Ratcliff-Obershelp's: twice the number of matched characters in
percent of both lengths.  Matched characters stand in the same order in both
words, so there are at most as many as both words have in common, order apart,
and as the longest common subsequence has.  Both filters are exact: they pass
every pair that can reach the wanted similarity.

Any key that similar words are sure to share, such as one of their rarest
bigrams, is also shared by a fixed part of all other words.  So words meet by
length, in blocks of bounded size dealt over all tasks; a block's letters in
common are one matrix product, and only what passes it becomes pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.operators.morphology import similarity
from scriptoria.session import cut_lineage

PERCENT = 80
# Letters of the words on one side of a block; words count as 16 at least.
BLOCK_LETTERS = 1 << 15
# Cells into which letters are counted, words in one matrix product, pairs whose letters are compared at once.
CELLS, ROWS, PAIRS = 256, 1024, 1 << 15
# Letters of a word, as bits of a number, in the second filter.
BITS = 64


def one_deletion(word: Column) -> Column:
    """The word and what each single deletion leaves of it."""
    n = F.length(word)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, n)))
    return F.array_distinct(F.concat(F.array(word), cut))


def within_one_edit(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, near, edits): vocabulary entries at Levenshtein distance 0 or 1 of each word (column ``word`` of both)."""
    keyed = [df.select("word").distinct().select("word", F.explode(one_deletion(F.col("word"))).alias("key")) for df in (words, vocabulary)]
    met = keyed[0].join(keyed[1].withColumnRenamed("word", "near"), "key").select("word", "near").distinct()
    return met.withColumn("edits", F.levenshtein("word", "near")).where("edits <= 1")


def _codes(words: list[str]) -> np.ndarray:
    """Code points of all words, one after the other."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _lengths(words: list[str]) -> np.ndarray:
    return np.fromiter(map(len, words), np.int64, len(words))


def _bags(words: list[str]) -> np.ndarray:
    """Letters of each word by cell; a letter's second occurrence counts as another letter.

    The product of two rows is at least the number of letters in common: where
    letters share a cell it is more.
    """
    rows = np.repeat(np.arange(len(words)), _lengths(words))
    letters = _codes(words)
    order = np.lexsort((letters, rows))
    rows, letters = rows[order], letters[order]
    place = np.arange(len(rows))
    again = np.zeros(len(rows), bool)
    again[1:] = (rows[1:] == rows[:-1]) & (letters[1:] == letters[:-1])
    occurrence = place - np.maximum.accumulate(np.where(again, 0, place))
    cell = ((letters * 0x9E3779B1 + occurrence * 0x85EBCA77) >> 16) % CELLS
    return np.bincount(rows * CELLS + cell, minlength=len(words) * CELLS).reshape(-1, CELLS).astype(np.float32)


def _table(words: list[str]) -> np.ndarray:
    """Code points of words of at most ``BITS`` letters, one row each, filled up with -1."""
    n = _lengths(words)
    table = np.full((len(words), n.max(initial=0)), -1, np.int64)
    table[np.arange(table.shape[1]) < n[:, None]] = _codes(words)
    return table


def _in_order(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each row of ``left`` and the same row of ``right``, which has no filling."""
    bits = np.uint64(1) << np.arange(left.shape[1], dtype=np.uint64)
    free = np.full(len(left), np.iinfo(np.uint64).max)
    for column in right.T:
        held = free & np.where(left == column[:, None], bits, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        free = (free + held) | (free - held)
    return np.unpackbits((~free).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1)


def _can_be_near(words: list[str], others: list[str], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs that pass both filters; ``others`` have one length."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    m, bags = len(others[0]) if others else 0, _bags(others)
    for start in range(0, len(words) if others else 0, ROWS):
        some = words[start : start + ROWS]
        need = np.ceil((_lengths(some) + m) * least / 200 - 1e-9)
        # Sums of floats may lack a little where a word has many thousands of letters.
        i, j = np.nonzero(_bags(some) @ bags.T * np.float32(1.0001) >= need[:, None].astype(np.float32))
        if m <= BITS and max(map(len, some)) <= BITS:
            left, right = _table(some), _table(others)
            for k in range(0, len(i), PAIRS):
                p, q = i[k : k + PAIRS], j[k : k + PAIRS]
                passed = _in_order(left[p], right[q]) >= need[p]
                found.append((p[passed] + start, q[passed]))
        else:
            found.append((i + start, j))
    return tuple(map(np.concatenate, zip(*found)))


def near_words(words: DataFrame, vocabulary: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(word, near, similarity) of all vocabulary entries at least ``percent`` similar to each word, distinct pairs compared once.

    Rounded half per cents count as reached, as in ``similarity``.  Words of
    one character match only themselves, nulls nothing.  ``percent`` is 80 at
    least: below, too many pairs pass the filters.
    """
    if percent < 80:
        raise ValueError("percent must be 80 or more")
    least = percent - 0.5
    asked, held = [cut_lineage(df.select("word").where("word IS NOT NULL").distinct()) for df in (words, vocabulary)]
    parts = -(-(asked.agg(F.sum(F.greatest(F.length("word"), F.lit(16)))).first()[0] or 0) // BLOCK_LETTERS) or 1
    near = held.select(F.col("word").alias("near"), F.length("word").alias("m"))
    # One row for each length of a word: fewer than the root of twice the vocabulary's letters.
    blocks = F.broadcast(near.groupBy("m").agg(F.ceil(F.count(F.lit(1)) * F.greatest("m", F.lit(16)) / BLOCK_LETTERS).alias("blocks")))
    n, m = F.length("word"), F.col("m")
    lengths = F.sequence(F.ceil(n * least / (200 - least) - 1e-9), F.floor(n * (200 - least) / least + 1e-9)).cast("array<int>")
    cells = (
        asked.select("word", F.pmod(F.xxhash64("word"), F.lit(parts)).alias("part"), F.explode(lengths).alias("m"))
        .where(F.least(n, m) * 200 >= (n + m) * least)
        .join(blocks, "m")
        .select("word", "m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), "part"),
        near.join(blocks, "m").select(
            "near", "m", F.pmod(F.xxhash64("near"), "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part")
        ),
    )
    # A set number of tasks: the blocks are few bytes and much work, so tasks must not be merged by size.
    tasks = 8 * asked.sparkSession.sparkContext.defaultParallelism
    grid = [df.repartition(tasks, "m", "block", "part").groupBy("m", "block", "part") for df in cells]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        i, j = _can_be_near(left["word"].to_pylist(), right["near"].to_pylist(), least)
        return pa.table({"word": left["word"].take(pa.array(i)), "near": right["near"].take(pa.array(j))})

    pairs = grid[0].cogroup(grid[1]).applyInArrow(meet, "word string, near string")
    return pairs.withColumn("similarity", similarity(F.col("word"), F.col("near"))).where(F.col("similarity") >= percent)
