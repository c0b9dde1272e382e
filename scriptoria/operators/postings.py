"""The inverted index as a table: one row per field, term and verse.

Layout on disk: files sorted by (field, term, verse_id), each with the entries
of some verses.  A term that occurs in a third of all verses spreads over all
files instead of filling one, and a look-up still reads few pages of each
because Parquet statistics on ``field`` and ``term`` prune the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions.normalize import indexed_plain_text, normalize
from scriptoria.functions.tokens import analyse
from scriptoria.operators.hierarchy import section_text
from scriptoria.session import small_or_merged

CONTENT_FIELDS = ("content", "no_diacritics")
VERSE_FIELDS = ("work", "work_id", "section", "section_id", "author")
LOOK_UP_ORDER = ["field", "term", "verse_id"]
# Sorted entries share most of their bytes with their neighbours.
COMPRESSION = "zstd"
# Text whose entries, some 100 bytes each, one task sorts in memory.
SEGMENT_BYTES = 32 << 20


def segments_for(docs: DataFrame, text: str) -> int:
    """Parts of an index of the texts in a column, by their bytes; never fewer than tasks that run at once."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(-(-size // SEGMENT_BYTES), docs.sparkSession.sparkContext.defaultParallelism)


def index_documents(
    verses: DataFrame, divisions: DataFrame | None = None, works: DataFrame | None = None
) -> DataFrame:
    """Verses with the text of every index field, one row per verse.

    ``verses`` needs verse_id, content, work_slug, language; with divisions
    (division_id, path, title_path, title_slug) and works (work_slug, title,
    authors) the descriptive fields are added.
    """
    docs = verses.where(F.length("content") > 0).select(
        *[c for c in verses.columns if c != "content"],
        normalize(F.col("content")).alias("content"),
        indexed_plain_text(F.col("content"), F.col("language")).alias("no_diacritics"),
    )
    if divisions is not None:
        described = divisions.select(
            "division_id",
            section_text(F.col("path"), F.col("title_path")).alias("section"),
            F.col("title_slug").alias("section_id"),
        )
        docs = docs.join(described, "division_id")
    if works is not None:
        described = works.select(
            F.col("title_slug").alias("work_slug"),
            F.concat("title", F.lit(","), "title_slug").alias("work"),
            F.col("title_slug").alias("work_id"),
            F.coalesce(F.get("authors", F.lit(0)), F.lit("")).alias("author"),
        )
        docs = docs.drop("work_id").join(described, "work_slug")
    return docs


# Entries that travel together.
_ENTRIES_PER_BATCH = 100_000


def _entries_of_texts(fields: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (verse_id, work_slug, for each field the tokens of each of its texts) to entries: field, term, verse_id, work_slug, positions.

    A token is coded by the place of its term among those of the batch; sorted by code and verse, an entry is a run of tokens.
    So the entries of a batch come in look-up order, and to sort a segment is to merge its batches.
    """

    def place(values: pa.Array) -> np.ndarray:
        """The place of each value if the values were sorted."""
        out = np.empty(len(values), np.int64)
        out[pc.array_sort_indices(values).to_numpy()] = np.arange(len(values))
        return out

    def entries(field: str, batch: pa.RecordBatch, texts: pa.ListArray) -> Iterator[pa.RecordBatch]:
        copies = texts.flatten()
        lengths = pc.list_value_length(copies).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.repeat(np.arange(len(texts)), pc.list_value_length(texts).to_numpy(zero_copy_only=False)), lengths)
        if not len(row):
            return
        tokens = copies.flatten().dictionary_encode()
        position = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        verse = place(batch.column(0))
        key = place(tokens.dictionary)[tokens.indices.to_numpy()] * len(verse) + verse[row]
        # Copies of a text stand one behind the other, so places are in order unless a text comes twice.
        order = np.lexsort((position, key)) if len(copies) > len(texts) else np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends = np.concatenate((first, [len(key)]))
        places = position[order].astype(np.int32)
        row, code = row[order[first]], tokens.indices.to_numpy()[order[first]]
        for a in range(0, len(first), _ENTRIES_PER_BATCH):
            b = min(a + _ENTRIES_PER_BATCH, len(first))
            at = pa.array(row[a:b])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([field]).take(pa.array(np.zeros(b - a, np.int64))), tokens.dictionary.take(pa.array(code[a:b])), batch.column(0).take(at), batch.column(1).take(at),
                    pa.ListArray.from_arrays(pa.array((ends[a : b + 1] - ends[a]).astype(np.int32)), pa.array(places[ends[a] : ends[b]])),
                ],
                names=["field", "term", "verse_id", "work_slug", "positions"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, field in enumerate(fields):
                yield from entries(field, batch, batch.column(2 + i))

    return run


def _counted(docs: DataFrame, fields: Sequence[str], word_analyser: str, terms: DataFrame | None, parts: int | None = None) -> DataFrame:
    """field, term, verse_id, work_slug and the sorted ``positions`` of the term, counted text by text.

    Rows that repeat a verse are put together first, so texts move once and
    entries don't.  With ``terms`` (field, term) texts stay where they are and
    a verse in several rows has several entries of a term.  ``parts`` is the
    number of partitions that the texts are dealt out to; left out, Spark's own.
    """
    own = docs.select("verse_id", "work_slug", F.struct(*fields).alias("t"))
    if terms is None:
        keys = ("verse_id", "work_slug")
        own = (own.repartition(parts, *keys) if parts else own.repartition(*keys)).groupBy("verse_id", "work_slug").agg(F.collect_list("t").alias("t"))
    else:
        own = own.withColumn("t", F.array("t"))
    none = F.array().cast("array<string>")

    def cut(f: str) -> Column:
        return F.transform("t", lambda t: F.coalesce(analyse(t[f], f, word_analyser), none))

    texts = own.select("verse_id", "work_slug", *[cut(f).alias(f"__{i}") for i, f in enumerate(fields)])
    kinds = dict(texts.dtypes)
    schema = f"field string, term string, verse_id {kinds['verse_id']}, work_slug {kinds['work_slug']}, positions array<int>"
    found = texts.mapInArrow(_entries_of_texts(list(fields)), schema)
    if terms is not None:
        # Spark doesn't know the size of a table made by the driver, and would shuffle all entries to meet two terms.
        found = found.join(small_or_merged(terms.select("field", "term").distinct()), ["field", "term"], "left_semi")
    return found.select("field", "term", "verse_id", "work_slug", "positions")


def build_postings(
    docs: DataFrame, fields: Sequence[str] = CONTENT_FIELDS, word_analyser: str = "word", terms: DataFrame | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Tokenise the given fields and count terms per verse.

    Tokens are counted inside the row of a verse.  For a search over text that
    is not indexed, ``terms`` (field, term) restricts the work to the terms
    asked for.
    """
    found = _counted(docs, fields, word_analyser, terms, parts)
    if terms is not None:
        found = found.groupBy("field", "term", "verse_id", "work_slug").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    return found.select("field", "term", "verse_id", "work_slug", F.size("positions").cast("bigint").alias("tf"), "positions")


def build_term_counts(
    docs: DataFrame, fields: Sequence[str] = CONTENT_FIELDS, word_analyser: str = "word", terms: DataFrame | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Postings without positions, for boolean search and statistics."""
    found = _counted(docs, fields, word_analyser, terms, parts).withColumn("tf", F.size("positions").cast("bigint")).drop("positions")
    if terms is not None:
        found = found.groupBy("field", "term", "verse_id", "work_slug").agg(F.sum("tf").alias("tf"))
    return found.select("field", "term", "verse_id", "work_slug", "tf")


def write_postings(postings: DataFrame, path: str, partitions: int | None = None, mode: str = "overwrite") -> None:
    """Persist in look-up order.

    Each partition of ``postings`` becomes a file sorted by field, term and
    verse, so entries stay in the task that counted them.  With ``partitions``
    they are exchanged first, and each file holds a range of terms.
    """
    ranged = postings.repartitionByRange(partitions, *LOOK_UP_ORDER) if partitions else postings
    ranged.sortWithinPartitions(*LOOK_UP_ORDER).write.mode(mode).option("compression", COMPRESSION).parquet(path)


def read_postings(spark: SparkSession, path: str, field: str, terms: Sequence[str]) -> DataFrame:
    """Entries of some terms of a stored index; the scan prunes by field and term."""
    return spark.read.parquet(path).where((F.col("field") == field) & F.col("term").isin(list(terms)))


def without_works(postings: DataFrame, work_slugs: DataFrame) -> DataFrame:
    """Postings without the given works (column ``work_slug``)."""
    return postings.join(work_slugs.select("work_slug").distinct(), "work_slug", "left_anti")


def works_to_index(works: DataFrame, postings: DataFrame) -> DataFrame:
    """Works (column ``work_slug``) the index does not hold yet."""
    return works.join(postings.select("work_slug").distinct(), "work_slug", "left_anti")


def reindex_works(postings: DataFrame, fresh: DataFrame) -> DataFrame:
    """Index after replacing the entries of every work that occurs in ``fresh``."""
    return without_works(postings, fresh.select("work_slug")).unionByName(fresh)
