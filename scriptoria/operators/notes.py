"""Readers' notes joined to the passages they refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.functions.strings import contains_ignoring_case
from scriptoria.operators.citations import resolve_parts
from scriptoria.operators.hierarchy import describe_path, verse_label

ANYTHING = "\u0000"


def allowed_passages(requests: DataFrame, divisions: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """Passages a request may match: the cited division and its counterparts in related works.

    ``requests``: request_id, work_slug, parts (NULL: the whole work).
    ``divisions``: work_slug, division_id, sequence_number, path.
    Returns request_id, work_slug, division_id, descriptor, verse.
    """
    everywhere = requests.select("request_id", "work_slug")
    if related is not None:
        linked = requests.join(related.select("work_slug", "related_slug"), "work_slug").select(
            "request_id", F.col("related_slug").alias("work_slug")
        )
        everywhere = everywhere.unionByName(linked).distinct()
    whole = requests.where(F.col("parts").isNull()).select("request_id").join(everywhere, "request_id").select(
        "request_id", "work_slug", F.lit(None).cast("bigint").alias("division_id"),
        F.lit(None).cast("string").alias("descriptor"), F.lit(None).cast("string").alias("verse"),
    )
    cited = requests.where(F.col("parts").isNotNull())
    resolved = resolve_parts(cited, divisions, ["request_id"])
    paths = divisions.select("division_id", "path")
    sections = resolved.join(paths, "division_id").select("request_id", "path", "verse")
    key = F.lower(F.array_join("path", "\u0001"))
    counterpart = (
        sections.withColumn("__key", key)
        .join(everywhere, "request_id")
        .join(divisions.select("work_slug", "division_id", key.alias("__key"), F.array_join("path", "/").alias("descriptor")), ["work_slug", "__key"])
        .select("request_id", "work_slug", "division_id", "descriptor", "verse")
    )
    return whole.unionByName(counterpart)


def notes_for_passages(notes: DataFrame, references: DataFrame, passages: DataFrame, search: str | None = None) -> DataFrame:
    """Notes that refer to an allowed passage, each once per request.

    A reference matches by division id or by full descriptor inside the work;
    the two are separate equi joins, united.
    """
    refs = references.select("note_id", F.col("work_title_slug").alias("work_slug"), "division_id", "division_full_descriptor", "verse_indicator")
    verse_fits = F.col("verse").isNull() | (F.col("verse") == F.col("verse_indicator"))
    cited = passages.where(F.col("division_id").isNotNull())
    by_id = refs.join(cited.select("request_id", "work_slug", "division_id", "verse"), ["work_slug", "division_id"]).where(verse_fits)
    by_name = refs.drop("division_id").join(
        cited.select("request_id", "work_slug", F.col("descriptor").alias("division_full_descriptor"), "verse"),
        ["work_slug", "division_full_descriptor"],
    ).where(verse_fits)
    by_work = refs.join(passages.where(F.col("division_id").isNull()).select("request_id", "work_slug"), "work_slug")
    pairs = (
        by_id.select("request_id", "note_id")
        .unionByName(by_name.select("request_id", "note_id"))
        .unionByName(by_work.select("request_id", "note_id"))
        .distinct()
    )
    wanted = notes if search is None else matching_notes(notes, search)
    return pairs.join(wanted, "note_id")


def matching_notes(notes: DataFrame, text: str) -> DataFrame:
    """Notes whose title or text contains the search text, whatever the case."""
    return notes.where(contains_ignoring_case(F.col("title"), text) | contains_ignoring_case(F.col("text"), text))


def page_of_notes(notes: DataFrame, page: int | None, count: int = 10) -> DataFrame:
    """Zero-based page by note id; page 0 and None mean no paging."""
    if not page:
        return notes
    return notes.orderBy("note_id").offset(page * count).limit(count)


def notes_per_verse(references: DataFrame, keys: list[str]) -> DataFrame:
    """Notes per verse indicator; references without an indicator count 0."""
    return references.groupBy(*keys, "verse_indicator").agg(F.count("verse_indicator").alias("notes"))


def unique_notes(notes: DataFrame) -> DataFrame:
    return notes.dropDuplicates(["note_id"])


def export_rows(notes: DataFrame, references: DataFrame, divisions: DataFrame, verses: DataFrame | None = None) -> DataFrame:
    """Notes for CSV: id, title, text, first work, references joined by ", " in reference order.

    The references of one note are collected: a note is written by hand and
    names a handful of passages.
    """
    described = references.join(divisions.select("division_id", "path"), "division_id")
    verse: Column = F.col("verse_indicator")
    if verses is not None:
        labels = verses.select("verse_id", verse_label(F.col("indicator"), F.col("sequence_number")).alias("__label"))
        described = described.join(labels, "verse_id", "left")
        verse = F.col("__label")
    described = described.withColumn("__text", describe_path(F.col("path"), verse))
    folded = described.groupBy("note_id").agg(
        F.min(F.struct("reference_id", "work_title_slug")).alias("first"),
        F.array_sort(F.collect_list(F.struct("reference_id", "__text"))).alias("refs"),
    ).select(
        "note_id", F.col("first.work_title_slug").alias("work"),
        F.array_join(F.transform("refs", lambda r: r["__text"]), ", ").alias("reference"),
    )
    return notes.join(folded, "note_id", "left").select(
        F.col("note_id").alias("id"), "title", "text", "work", F.coalesce("reference", F.lit("")).alias("reference")
    )
