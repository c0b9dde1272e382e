"""Reading order: readable units, neighbours, page strips and progress for all divisions at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.operators.ordered import DEFAULT_WIDTH, carry, halo_window, number_rows, running_sum


def chapter_of(divisions: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Forward as-of: the first readable division at or after each division of its work."""
    return carry(
        divisions, ["work_slug"], "sequence_number",
        {"chapter_id": F.when(F.col("readable_unit"), F.col("division_id"))},
        backward=True, inclusive=True, chunk=chunk,
    )


def neighbours(divisions: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Previous and next readable division of the work."""
    readable = F.when(F.col("readable_unit"), F.col("division_id"))
    earlier = carry(divisions, ["work_slug"], "sequence_number", {"previous_id": readable}, chunk=chunk)
    return carry(earlier, ["work_slug"], "sequence_number", {"next_id": readable}, backward=True, chunk=chunk)


def _percent(done: Column, total: Column) -> Column:
    return done * F.lit(100.0) / total


def progress(chapters: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Chapters completed, remaining and percent, in the work and in the book (same parent).

    ``chapters`` are the readable divisions.  Without a parent the book figures are NULL.
    """
    one = F.lit(1).cast("bigint")
    in_work = running_sum(
        chapters, ["work_slug"], "sequence_number", {"completed": one}, chunk, {"completed": "total"}
    )
    book = in_work.withColumn("__book", F.coalesce("parent_id", F.lit(-1).cast("bigint")))
    in_book = running_sum(
        book, ["work_slug", "__book"], "sequence_number", {"__done": one}, chunk, {"__done": "__all"}
    )
    has_book = F.col("parent_id").isNotNull()
    return in_book.select(
        *chapters.columns,
        "total", "completed",
        (F.col("total") - F.col("completed")).alias("remaining"),
        _percent(F.col("completed"), F.col("total")).alias("percent"),
        F.when(has_book, F.col("__all")).alias("total_in_book"),
        F.when(has_book, F.col("__done")).alias("completed_in_book"),
        F.when(has_book, F.col("__all") - F.col("__done")).alias("remaining_in_book"),
        F.when(has_book, _percent(F.col("__done"), F.col("__all"))).alias("percent_in_book"),
    )


def page_strip(chapters: DataFrame, count: int = 9, chunk: Column | None = None, tile: int = DEFAULT_WIDTH) -> DataFrame:
    """Ids of the chapters around each chapter under the same parent, in order.

    Half of ``count`` minus one, rounded up, ends with the chapter itself; the
    other half follows it.
    """
    upto = math.ceil((count - 1) / 2)
    after = math.floor((count - 1) / 2)
    book = chapters.withColumn("__book", F.coalesce("parent_id", F.lit(-1).cast("bigint")))
    placed = number_rows(book, ["work_slug", "__book"], "sequence_number", "__place", chunk=chunk)
    return halo_window(
        placed, ["work_slug", "__book"], "__place", upto - 1, after,
        lambda w: {"strip": F.collect_list("division_id").over(w.rowsBetween(-(upto - 1), after))},
        tile=tile,
    ).drop("__book", "__place")


def first_divisions(divisions: DataFrame, k: int = 1, readable_only: bool = False, descending: bool = False) -> DataFrame:
    """The first (or last) k divisions of one selection by sequence."""
    rows = divisions.where("readable_unit") if readable_only else divisions
    order = F.desc("sequence_number") if descending else F.asc("sequence_number")
    return rows.orderBy(order).limit(k)


def related_with_section(related: DataFrame, divisions: DataFrame, chapters: DataFrame) -> DataFrame:
    """Related works that really contain the section: (division_id, related_slug) pairs.

    ``related``: work_slug, related_slug; paths compare without regard to case.
    """
    key = F.lower(F.array_join("path", "\u0001"))
    known = divisions.select(F.col("work_slug").alias("related_slug"), key.alias("__path"))
    wanted = chapters.select("work_slug", "division_id", key.alias("__path")).join(related, "work_slug")
    return wanted.join(known, ["related_slug", "__path"], "left_semi").select("work_slug", "division_id", "related_slug")


def passage_text(passages: DataFrame, chapters: DataFrame, verses: DataFrame) -> DataFrame:
    """Verses of cited passages: the whole readable unit, or the one cited verse.

    ``passages``: citation_id, division_id, verse; ``chapters``: division_id,
    chapter_id (see ``chapter_of``).
    """
    located = passages.join(chapters.select("division_id", "chapter_id"), "division_id")
    body = verses.select(F.col("division_id").alias("chapter_id"), "verse_id", "sequence_number", "indicator", "content")
    return located.join(body, "chapter_id").where(
        F.col("verse").isNull() | (F.col("indicator") == F.col("verse"))
    )
