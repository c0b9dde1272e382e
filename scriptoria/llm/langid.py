"""Language identification by string kernels.

The blended-spectrum presence kernel of two texts counts the character n-grams,
n = 1 to 4, that both hold, however often, and is divided by the root of the
two own values.  n-grams are taken over the UTF-8 bytes of the lower-cased text
and hashed to ``CELLS`` cells.  A long text would fill the cells whatever its
language, so it is cut into consecutive pieces of at most ``PIECE_BYTES`` bytes;
each piece is scored by its own bits, and the text's scores are the mean over all its
pieces, weighted by length.  Training takes pieces of the same length.
A text that is no text of any learned language scores low: the sample also gives
shorter cuts, and ``KNOWN_SHARE`` of what nearly all of a size reach is what a
text of that size must reach to count as known.
Landmarks - some pieces of each language - give Nyström features, and
ridge regression, one language against the rest, is fitted on a bounded sample.

As features and regression are both linear in the landmark kernels, they fold
into one matrix of cells x languages; a block of pieces is scored by one product
of its presence bits with that matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.llm.rows import column_of, map_slices, table

CELLS = 1 << 14
SPECTRUM = (1, 2, 3, 4)
# Bounds of the training sample: pieces and, of them, landmarks of each language.
SAMPLE_PER_LANGUAGE = 400
LANDMARKS_PER_LANGUAGE = 48
# Bounds of both over all languages, dealt evenly; so many languages, the most frequent, are learned at most.
SAMPLE_ROWS = 4096
LANDMARKS = 512
RIDGE = 1e-3
# Odd multipliers that spread the n-grams over the cells.
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)
# A text is known from this share of the score that all but ``LOW_SHARE`` of the sampled cuts of its size reach.
KNOWN_SHARE, LOW_SHARE = 0.5, 0.01
# Sampled pieces are also cut to these parts of their length.
CUT_BITS = (3, 6)
_PIECE = 1 << 20
# Bytes of a piece that is scored by itself, and pieces that one product scores.
PIECE_BYTES = 4096
BLOCK_PIECES = 256


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode(), dtype=np.uint8)


def presence(text: str | np.ndarray) -> np.ndarray:
    """One byte for each cell, 1 where the whole text, or the codes given, have an n-gram of that cell."""
    bits = np.zeros(CELLS, dtype=np.uint8)
    codes = codes_of(text) if isinstance(text, str) else text
    for at in range(0, len(codes), _PIECE):
        part = codes[at : at + _PIECE + max(SPECTRUM) - 1].astype(np.uint32)
        total = np.zeros(len(part), dtype=np.uint32)
        for k, n in enumerate(range(1, max(SPECTRUM) + 1)):
            if len(part) < n:
                break
            total = total[: len(part) - n + 1] + (part[n - 1 :] + np.uint32(257)) * _MULTIPLIERS[k]
            if n in SPECTRUM:
                mixed = (total ^ (total >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                bits[mixed >> np.uint32(18)] = 1
    return bits


def bounds_of(n_bytes: int) -> np.ndarray:
    """Where the pieces of a text of so many bytes begin and end: pieces of one length, to a byte, at least one."""
    n = max(1, -(-n_bytes // PIECE_BYTES))
    return n_bytes * np.arange(n + 1) // n


def piece_of(codes: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """Piece ``k`` and the bytes after it that end an n-gram of it, so no n-gram of the text is lost."""
    return codes[bounds[k] : bounds[k + 1] + max(SPECTRUM) - 1]


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, float, np.ndarray]]:
    """(number of the text, share of its length, presence) of all pieces of each text; None has none."""
    for k, t in enumerate(texts):
        if t is not None:
            codes = codes_of(t)
            bounds = bounds_of(len(codes))
            for j in range(len(bounds) - 1):
                yield k, (bounds[j + 1] - bounds[j]) / max(len(codes), 1), presence(piece_of(codes, bounds, j))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Model:
    """Scores of a piece: presence bits times ``matrix``, divided by the root of the number of bits; of a text, their mean by length."""

    def __init__(self, languages: list[str], matrix: np.ndarray, floors: np.ndarray | None = None):
        self.languages, self.matrix = languages, matrix.astype(np.float32)
        # Least score of a known piece by the binary length of its number of bits.
        self.floors = np.zeros(CELLS.bit_length() + 1) if floors is None else floors

    @property
    def learned(self) -> bool:
        """Not so where there was nothing to learn from: ``und`` then says nothing about a text."""
        return self.languages != ["und"]

    def scores(self, bits: np.ndarray) -> np.ndarray:
        """Scores of pieces given by their presence, for each language."""
        return bits.astype(np.float32) @ self.matrix / np.sqrt(np.maximum(bits.sum(axis=1, dtype=np.int64), 1))[:, None]

    def calibrated(self, bits: np.ndarray) -> Model:
        """With floors from the best scores of sampled pieces and cuts; a size below all that were sampled has none."""
        best, sizes = self.scores(bits).max(axis=1), size_class(bits)
        floors = np.zeros_like(self.floors)
        for k in range(len(floors)):
            own = best[sizes == k]
            floors[k] = KNOWN_SHARE * np.quantile(own, LOW_SHARE) if len(own) else floors[max(k - 1, 0)]
        return Model(self.languages, self.matrix, np.maximum(floors, 0))

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float, bool]]:
        """(language, score, known) of each text."""
        judged = list(map(has_letter, texts))
        scores, floors = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        pieces = _pieces([t if ok else None for t, ok in zip(texts, judged)])
        while block := list(islice(pieces, BLOCK_PIECES)):
            bits = np.stack([b for _, _, b in block])
            share = np.array([share for _, share, _ in block])
            np.add.at(scores, [k for k, _, _ in block], self.scores(bits) * share[:, None])
            np.add.at(floors, [k for k, _, _ in block], self.floors[size_class(bits)] * share)
        best = scores.argmax(axis=1)
        for k, ok in enumerate(judged):
            score = scores[k, best[k]]
            yield (self.languages[best[k]], float(np.clip(score, 0.0, 1.0)), bool(score >= floors[k])) if ok else ("und", 0.0, False)


def size_class(bits: np.ndarray) -> np.ndarray:
    """Binary length of the number of cells that each piece sets."""
    return np.frexp(bits.sum(axis=1, dtype=np.int64).astype(np.float64))[1]


# For use without a trained model: ``any`` where a text has a letter, ``und`` where it has none.
LETTERS_ONLY = Model(["any"], np.zeros((CELLS, 1)))


def fit(bits: np.ndarray, labels: list[str], landmarks_per_language: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model:
    """``bits``: a row of presence for each training piece; the first of a language are its landmarks."""
    languages = sorted(set(labels))
    place = {x: k for k, x in enumerate(languages)}
    number = np.array([place[x] for x in labels])
    landmarks_per_language = min(landmarks_per_language, max(1, LANDMARKS // len(languages)))
    size = np.sqrt(np.maximum(bits.sum(axis=1, dtype=np.int64), 1))
    marks = np.concatenate([np.flatnonzero(number == k)[:landmarks_per_language] for k in range(len(languages))])
    # Counts of common cells are exact in 32 bits; blocks, so that only the landmarks are held in full.
    held = bits[marks].astype(np.float32)
    common = np.concatenate([bits[at : at + BLOCK_PIECES].astype(np.float32) @ held.T for at in range(0, len(bits), BLOCK_PIECES)])
    kernel = common.astype(np.float64) / size[:, None] / size[marks]
    values, vectors = np.linalg.eigh(kernel[marks])
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ root
    # Each language weighs the same, however many texts it has.
    weight = (1.0 / np.bincount(number))[number][:, None] * len(labels) / len(languages)
    wanted = (number[:, None] == np.arange(len(languages))).astype(np.float64)
    gram = features.T @ (features * weight) + ridge * len(labels) * np.eye(features.shape[1])
    beta = np.linalg.solve(gram, features.T @ (wanted * weight))
    share = root @ beta / size[marks][:, None]
    matrix = np.empty((bits.shape[1], len(languages)), dtype=np.float32)
    for at in range(0, len(matrix), BLOCK_PIECES):
        matrix[at : at + BLOCK_PIECES] = held[:, at : at + BLOCK_PIECES].T.astype(np.float64) @ share
    return Model(languages, matrix)


def training_sample(documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Presence bits and languages of at most ``per_language`` pieces of each language, from texts chosen by a hash of their id.

    The third value has the bits of shorter cuts, of the first piece of each text.

    A language with fewer texts gives several pieces of each, evenly spaced over
    the whole text, the middle one first.  At most ``LANDMARKS`` languages are
    learned, the most frequent ones, and ``SAMPLE_ROWS`` is dealt evenly over them.
    The choice runs over all rows with id and language only; what reaches the
    driver are the languages' names and 2 KB for each piece.
    """
    usable = documents.where("lang <> 'und' AND text IS NOT NULL")  # und is the want of a language
    counted = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANDMARKS)
    learned = [(r["lang"],) for r in counted.collect()]
    usable = usable.join(F.broadcast(documents.sparkSession.createDataFrame(learned, "lang string")), "lang", "left_semi")
    per_language = min(per_language, SAMPLE_ROWS // max(1, len(learned)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id")
    chosen = usable.select("doc_id", "lang").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_language)
    ids = F.broadcast(chosen.select("doc_id", "lang"))  # SAMPLE_ROWS at most
    texts = usable.select("doc_id", "lang", "text").join(ids, ["doc_id", "lang"], "left_semi")

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": [], "lang": [], "place": [], "bits": [], "cuts": []}
        for i, lang, take, text in zip(*(column_of(batch, c).to_pylist() for c in ("doc_id", "lang", "take", "text"))):
            codes = codes_of(text)
            bounds = bounds_of(len(codes))
            n = len(bounds) - 1
            spaced = sorted({(2 * k + 1) * n // (2 * take) for k in range(take)}, key=lambda j: (abs(2 * j - n), j))
            for place, j in enumerate(spaced):
                piece = piece_of(codes, bounds, j)
                cuts = [np.packbits(presence(piece[: max(1, len(piece) >> b)])).tobytes() for b in CUT_BITS] if place == 0 else []
                for name, value in zip(out, (i, lang, place, np.packbits(presence(piece)).tobytes(), cuts)):
                    out[name].append(value)
        return out

    one_each = texts.groupBy("doc_id", "lang").agg(F.max("text").alias("text"))  # an id may stand in many rows
    takes = F.greatest(F.lit(1), F.floor(F.lit(per_language) / F.count(F.lit(1)).over(Window.partitionBy("lang"))))
    wanted = one_each.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", takes.cast("bigint").alias("take"), "text")
    rows = map_slices(wanted, "doc_id bigint, lang string, place bigint, bits binary, cuts array<binary>", run).collect()
    rows = sorted(rows, key=lambda r: (r["lang"], r["place"], r["doc_id"], bytes(r["bits"])))
    unpacked = lambda found: np.array([np.unpackbits(np.frombuffer(bytes(b), np.uint8)) for b in found], dtype=np.uint8).reshape(-1, CELLS)
    return unpacked([r["bits"] for r in rows]), [r["lang"] for r in rows], unpacked([b for r in rows for b in r["cuts"]])


def train(documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, landmarks: int = LANDMARKS_PER_LANGUAGE) -> Model:
    """Learn from doc_id, text and lang; without a single usable row every text is ``und`` and the model is not ``learned``."""
    bits, labels, cuts = training_sample(documents, per_language)
    return fit(bits, labels, landmarks).calibrated(np.concatenate([bits, cuts])) if labels else Model(["und"], np.zeros((CELLS, 1)))


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """Add lang_pred, score and lang_known to all columns of ``documents`` (text); columns of those names are replaced.

    Only the whole text is looked at.  ``und`` with score 0 where the text is
    null or has no letter (a sign that ``str.isalpha`` knows).  ``lang_known``
    says whether the score is that of a text in a learned language.  Of
    languages with equal scores the first by name is taken.  At most
    ``LANDMARKS`` languages are ever predicted, the most frequent of the
    training rows.  Equal texts get equal rows; an empty table gives none.
    """
    own = [c for c in documents.columns if c.lower() not in ("lang_pred", "score", "lang_known")]
    rows = documents.select(F.struct(F.lit(0), *(F.col(f"`{c}`") for c in own if c != "text")).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        found = list(model.predict(column_of(batch, "text").to_pylist()))
        return {"row": column_of(batch, "row"), "text": column_of(batch, "text"), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "lang_known": [f[2] for f in found]}

    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string, lang_pred string, score double, lang_known boolean"
    judged = map_slices(rows, schema, run, rows=256)
    return judged.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in own), "lang_pred", "score", "lang_known")


def held_out() -> Column:
    """Documents that training never sees."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def trained_on_the_rest(documents: DataFrame) -> Model:
    return train(documents.where(~held_out()))


def op4_language_id(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = trained_on_the_rest(documents)
    return identify(documents.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
