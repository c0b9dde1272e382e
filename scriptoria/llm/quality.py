"""Quality grades by an ordinal cumulative-link regression over hashed text features.

A text has one score, the sum of the weights of its features, shared by all
grades; ordered thresholds cut the score:  P(grade <= k) = sigmoid(t_k - score).
That gives the expected grade and the tail probability P(grade >= k) by which
documents are selected.  Features are presences: each blank-separated piece of
the whole text gives its word (A-Z lower-cased, punctuation stripped), its
trailing and leading punctuation, and whether it is written in capitals; the
text gives its shares of different words, different lines, punctuation and
capitals, in tenths.  Features of a few texts of the sample only have no weight.

The model is fitted on the driver on a bounded sample of labelled rows.  The
table of weights, of a fixed size, goes to the tasks, which score every text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.rows import byte_texts, column_of, map_slices, table

CELLS = 1 << 17
# Bound of the training sample: labelled rows.
SAMPLE_ROWS = 8000
# Pieces whose features a task remembers.
_REMEMBERED = 200_000


def _cell(feature: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(feature, digest_size=4).digest(), "little") % CELLS


class Features(dict):
    """piece -> cells of its features; forgets everything when it has grown too large."""

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        if len(self) >= _REMEMBERED:
            self.clear()
        word = piece.strip(_MARKS)
        names = [b"w" + word.lower()] if word else []
        if len(piece) > len(word):
            at = piece.find(word) if word else 0
            names += [b"<" + piece[:at], b">" + piece[at + len(word) :]]
        if len(word) > 1 and word.isupper():
            names.append(b"capitals")
        cells = self[piece] = tuple(_cell(n) for n in names)
        return cells

    def of(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct cells of a whole text."""
        cells: set[int] = set()
        pieces = text.split() if text else []
        distinct = set(pieces)
        for piece in distinct:
            cells.update(self[piece])
        if pieces:
            marks = len(text) - len(text.translate(None, _MARKS))
            capitals = len(text) - len(text.translate(None, _CAPITALS))
            lines = [x for x in text.split(b"\n") if x]
            shares = {b"distinct": len(distinct) / len(pieces), b"marks": marks / len(text), b"capitals": capitals / len(text), b"lines": len(set(lines)) / max(1, len(lines))}
            cells.update(_SHARES[name, round(10 * share)] for name, share in shares.items())
        return np.array(sorted(cells), dtype=np.int64)


_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SHARES = {(name, k): _cell(b"share %s %d" % (name, k)) for name in (b"distinct", b"marks", b"capitals", b"lines") for k in range(11)}


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights.astype(np.float32), thresholds

    def grades(self, cells: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and P(grade >= k) for k = 1 to the highest grade, of each text."""
        scores = np.array([self.weights[c].sum(dtype=np.float64) for c in cells])
        tails = 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))
        return tails.sum(axis=1), tails


def fit(cells: list[np.ndarray], grades: np.ndarray, steps: int = 200, rate: float = 0.05, lasso: float = 1e-3, least_texts: int = 5) -> Model:
    """Penalised maximum likelihood with ordered thresholds, all grades weighing the same, by Adam over the whole sample.

    The penalty on absolute weights leaves features that say nothing at zero.

    The first threshold is free and the others add squares, so they stay ordered.
    """
    top = int(grades.max()) if len(grades) else 0
    if top == 0:
        return Model(np.zeros(CELLS), np.zeros(1))  # nothing to tell apart
    ends = np.cumsum([len(c) for c in cells])
    owner = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    flat = np.concatenate(cells) if len(ends) and ends[-1] else np.zeros(0, np.int64)
    common = np.bincount(flat, minlength=CELLS) >= least_texts
    owner, flat = owner[common[flat]], flat[common[flat]]
    used, inverse = np.unique(flat, return_inverse=True)
    counts = np.bincount(grades, minlength=top + 1)
    balance = (len(grades) / np.maximum(counts, 1) / max(1, (counts > 0).sum()))[grades]
    w, base = np.zeros(len(used)), np.zeros(top)  # base: first threshold, then roots of the gaps
    base[1:] = 1.0
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, base)]
    rows = np.arange(len(grades))
    for step in range(1, steps + 1):
        score = np.bincount(owner, weights=w[inverse], minlength=len(grades))
        edges = np.concatenate([[base[0]], base[0] + np.cumsum(base[1:] ** 2 + 1e-3)])
        below = np.concatenate([np.zeros((len(grades), 1)), 1 / (1 + np.exp(np.clip(score[:, None] - edges, -50, 50))), np.ones((len(grades), 1))], axis=1)
        slope = below * (1 - below)
        share = np.maximum(below[rows, grades + 1] - below[rows, grades], 1e-9)
        high, low = slope[rows, grades + 1] / share * balance, slope[rows, grades] / share * balance
        by_score = high - low  # derivative of the loss by the score
        by_edge = np.zeros(top + 2)
        np.add.at(by_edge, grades + 1, -high)
        np.add.at(by_edge, grades, low)
        by_edge = by_edge[1:-1]
        gradients = [
            np.bincount(inverse, weights=by_score[owner], minlength=len(used)) / len(grades),
            np.concatenate([[by_edge.sum()], np.cumsum(by_edge[::-1])[::-1][1:] * 2 * base[1:]]) / len(grades),
        ]
        for value, gradient, (mean, square) in zip((w, base), gradients, moments):
            mean += 0.1 * (gradient - mean)
            square += 0.001 * (gradient**2 - square)
            pace = rate / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
            value -= pace * (mean / (1 - 0.9**step))
            if value is w:  # weights within their step of the penalty are zero
                w[:] = np.sign(w) * np.maximum(np.abs(w) - lasso * pace, 0)
    weights = np.zeros(CELLS)
    weights[used] = w
    return Model(weights, np.concatenate([[base[0]], base[0] + np.cumsum(base[1:] ** 2 + 1e-3)]))


def training_sample(documents: DataFrame, ratings: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and grades of at most ``sample_rows`` rated documents (ratings: doc_id, grade), chosen by a hash of the id."""
    rated = ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample_rows)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    one_each = texts.groupBy("doc_id", "grade").agg(F.max("text").alias("text"))
    features = Features()

    def run(batch: pa.RecordBatch) -> dict:
        cells = [features.of(t).astype(np.int32).tobytes() for t in byte_texts(batch)]
        return {"doc_id": column_of(batch, "doc_id"), "grade": column_of(batch, "grade"), "cells": cells}

    rows = map_slices(one_each.select("doc_id", F.col("grade").cast("int").alias("grade"), "text"), "doc_id bigint, grade int, cells binary", run).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [np.frombuffer(bytes(r["cells"]), np.int32).astype(np.int64) for r in rows], np.array([r["grade"] for r in rows], dtype=np.int64)


def train(documents: DataFrame, ratings: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    return fit(*training_sample(documents, ratings, sample_rows))


def grade_documents(documents: DataFrame, model: Model, least_grade: int, least_tail: float = 0.25) -> DataFrame:
    """Add expected_grade, p_tail = P(grade >= least_grade) and kept to ``documents`` (text); those names are replaced.

    A null or empty text has no features and gets the grade of the thresholds
    alone.  Equal texts get equal grades; an empty table gives no rows.
    """
    own = [c for c in documents.columns if c.lower() not in ("expected_grade", "p_tail", "kept")]
    rows = documents.select(F.struct(F.lit(0), *(F.col(f"`{c}`") for c in own if c != "text")).alias("row"), F.col("text").cast("string").alias("text"))
    features, k = Features(), min(least_grade, len(model.thresholds)) - 1

    def run(batch: pa.RecordBatch) -> dict:
        expected, tails = model.grades([features.of(t) for t in byte_texts(batch)])
        return {
            "row": column_of(batch, "row"), "text": column_of(batch, "text"), "expected_grade": expected.tolist(),
            "p_tail": tails[:, k].tolist(), "kept": (tails[:, k] >= least_tail).tolist(),
        }

    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string, expected_grade double, p_tail double, kept boolean"
    graded = map_slices(rows, schema, run)
    return graded.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in own), "expected_grade", "p_tail", "kept")


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades of the label table: 0 toxic, 1 of low quality, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))


def op9_quality_classifier(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(documents, ratings_of(table(spark, sf_dir, "labels")))
    return grade_documents(documents, model, least_grade=2).drop("text")
