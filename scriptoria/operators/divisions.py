"""Building divisions and verses from ordered lines, and checks on the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.operators.ordered import carry, number_rows, running_sum


def book_chapter_islands(lines: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Gaps and islands over ordered lines.

    ``lines``: work, pos (order of the line), book, chapter.  A new book
    starts when the book changes; a new chapter when the chapter or the book
    changes.  Adds ``book_no``, ``chapter_no`` (running numbers in the work).
    """
    here = {"__book": F.col("book"), "__chapter": F.col("chapter")}
    before = carry(lines, ["work"], "pos", here, chunk=chunk)
    new_book = F.col("__book").isNull() | (F.col("book") != F.col("__book"))
    new_chapter = new_book | ~F.col("chapter").eqNullSafe(F.col("__chapter"))
    counted = running_sum(
        before, ["work"], "pos",
        {"book_no": new_book.cast("bigint"), "chapter_no": new_chapter.cast("bigint")}, chunk=chunk,
    )
    return counted.drop("__book", "__chapter")


def divisions_of_islands(islands: DataFrame) -> DataFrame:
    """One division per book and per chapter, numbered together in file order.

    A book precedes its first chapter, so the sequence number of a division is
    the count of books and chapters begun up to it.
    """
    first = F.min("pos").alias("pos")
    books = islands.groupBy("work", "book_no").agg(first, F.min("book").alias("descriptor"), F.min("chapter_no").alias("chapter_no"))
    chapters = islands.groupBy("work", "book_no", "chapter_no").agg(first, F.min("chapter").alias("descriptor"))
    # Books and chapters begun before this one, plus itself.
    book_rows = books.select(
        "work", "pos", "descriptor", F.col("descriptor").alias("title"), F.lit("Book").alias("type"), F.lit(1).alias("level"),
        (F.col("book_no") + F.col("chapter_no") - 1).alias("sequence_number"),
        F.lit(None).cast("bigint").alias("parent_sequence"), F.lit(False).alias("readable_unit"),
        "book_no", F.lit(None).cast("bigint").alias("chapter_no"),
    )
    first_chapter = books.select("work", "book_no", F.col("chapter_no").alias("__first"))
    chapter_rows = chapters.join(first_chapter, ["work", "book_no"]).select(
        "work", "pos", "descriptor", F.lit(None).cast("string").alias("title"), F.lit("Chapter").alias("type"),
        F.lit(2).alias("level"), (F.col("book_no") + F.col("chapter_no")).alias("sequence_number"),
        (F.col("book_no") + F.col("__first") - 1).alias("parent_sequence"), F.lit(True).alias("readable_unit"),
        "book_no", "chapter_no",
    )
    return book_rows.unionByName(chapter_rows)


def verses_of_islands(islands: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Verses numbered inside their chapter; indicator is verse plus subverse."""
    numbered = number_rows(islands, ["work", "chapter_no"], "pos", "sequence_number", chunk=chunk)
    indicator = F.concat(F.coalesce("verse", F.lit("")), F.coalesce("subverse", F.lit("")))
    return numbered.select("work", "pos", "book_no", "chapter_no", "sequence_number", indicator.alias("indicator"), F.col("text").alias("content"))


def orphan_divisions(divisions: DataFrame, verses: DataFrame) -> DataFrame:
    """Divisions without a verse and without a child (one pass: parents emptied by it stay)."""
    parents = divisions.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("division_id")).distinct()
    owners = verses.select("division_id").distinct()
    return divisions.join(owners, "division_id", "left_anti").join(parents, "division_id", "left_anti")


def without_orphans(divisions: DataFrame, verses: DataFrame) -> DataFrame:
    return divisions.join(orphan_divisions(divisions, verses).select("division_id"), "division_id", "left_anti")


def mark_readable(divisions: DataFrame, verses: DataFrame, leaves_only: bool | Column = False) -> DataFrame:
    """A division is readable when it owns a verse, with ``leaves_only`` only if it has no child."""
    owners = verses.select("division_id", F.lit(True).alias("__owns")).distinct()
    parents = (
        divisions.where(F.col("parent_id").isNotNull())
        .select(F.col("parent_id").alias("division_id"), F.lit(True).alias("__has_child"))
        .distinct()
    )
    only = leaves_only if isinstance(leaves_only, Column) else F.lit(leaves_only)
    owns = F.coalesce("__owns", F.lit(False))
    has_child = F.coalesce("__has_child", F.lit(False))
    return (
        divisions.drop("readable_unit")
        .join(owners, "division_id", "left")
        .join(parents, "division_id", "left")
        .withColumn("readable_unit", owns & ~(only & has_child))
        .drop("__owns", "__has_child")
    )


def default_descriptors(divisions: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Divisions without a descriptor get their count at their level in the file."""
    numbered = number_rows(divisions, ["file", "level"], "sequence_number", "__nth", chunk=chunk)
    return numbered.withColumn("descriptor", F.coalesce("descriptor", F.col("__nth").cast("string"))).drop("__nth")


def parents_by_level(divisions: DataFrame, group: str, order: str, chunk: Column | None = None) -> DataFrame:
    """Parent: the nearest earlier division of a smaller level.

    One carried value for each level there is; the parent is the latest among
    the levels above.  Adds ``parent_order`` (order value of the parent, or NULL).
    """
    levels = sorted(r["level"] for r in divisions.select("level").distinct().collect() if r["level"] is not None)
    if not levels:
        return divisions.withColumn("parent_order", F.lit(None).cast(divisions.schema[order].dataType))
    seen = {f"__l{k}": F.when(F.col("level") == k, F.col(order)) for k in levels}
    carried = carry(divisions, [group], order, seen, chunk=chunk)
    above = F.array(*[F.when(F.col("level") > k, F.col(f"__l{k}")) for k in levels])
    return carried.withColumn("parent_order", F.array_max(above)).drop(*seen)
