"""Division trees: ancestor chains, descendants, labels and citations of a division."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.session import cut_lineage, merged


def division_label(title: Column, kind: Column, descriptor: Column, sequence_number: Column) -> Column:
    """Title, else type and descriptor, else descriptor, else sequence number; an empty title is skipped."""
    return F.coalesce(
        F.when(F.length(title) > 0, title),
        F.when(kind.isNotNull() & descriptor.isNotNull(), F.concat(kind, F.lit(" "), descriptor)),
        descriptor,
        sequence_number.cast("string"),
    )


def with_ancestors(divisions: DataFrame) -> DataFrame:
    """Add ``ancestor_ids``, ``path`` (descriptors) and ``title_path`` (labels), root first.

    Expects division_id, parent_id, descriptor, title, type, sequence_number.
    Each round puts the chain of the highest known ancestor in front, so the
    known part doubles and a tree of depth d takes log2(d) rounds; a round is
    stored.  A parent that is no row ends the chain.  A cycle is an error.
    """
    label = division_label(F.col("title"), F.col("type"), F.col("descriptor"), F.col("sequence_number"))
    link = F.struct(F.col("division_id").alias("id"), F.col("descriptor").alias("d"), label.alias("l"))
    rows = divisions.select("division_id", F.col("parent_id").alias("__up"), F.array(link).alias("__chain"))
    climbed = 1
    while True:
        above = rows.select(F.col("division_id").alias("__pid"), F.col("__up").alias("__next"), F.col("__chain").alias("__above"))
        joined = rows.join(merged(above), F.col("__up") == F.col("__pid"), "left")
        chain = F.when(F.col("__above").isNull(), F.col("__chain")).otherwise(F.concat("__above", "__chain"))
        rows = cut_lineage(joined.select("division_id", F.col("__next").alias("__up"), chain.alias("__chain")))
        climbed *= 2
        if not rows.where(F.col("__up").isNotNull()).limit(1).count():
            break
        # A chain holds each division once: one that is longer than the table runs in a circle.
        if climbed > rows.count():
            raise ValueError("a division is its own ancestor")
    chains = rows.select(
        "division_id",
        F.transform("__chain", lambda c: c["id"]).alias("ancestor_ids"),
        F.transform("__chain", lambda c: c["d"]).alias("path"),
        F.transform("__chain", lambda c: c["l"]).alias("title_path"),
    )
    keep = [c for c in divisions.columns if c not in ("ancestor_ids", "path", "title_path")]
    return divisions.select(*keep).join(merged(chains), "division_id")


def descendants(divisions: DataFrame, division_id: int | Column, include_self: bool = False) -> DataFrame:
    """All divisions below one division (needs ``ancestor_ids``)."""
    target = division_id if isinstance(division_id, Column) else F.lit(division_id)
    below = divisions.where(F.array_contains("ancestor_ids", target))
    return below if include_self else below.where(F.col("division_id") != target)


def path_string(path: Column) -> Column:
    return F.array_join(path, "/")


def describe_path(path: Column, verse: Column | None = None, divider: str = " ") -> Column:
    """Human-readable citation: adjacent numbers are joined by a period, others by a blank.

    The verse is attached by a period when the text already holds one, else by
    a colon.
    """
    number = r"^[0-9]+ ?$"
    folded = F.aggregate(
        path,
        F.struct(F.lit("").alias("text"), F.lit(False).alias("number"), F.lit(True).alias("start")),
        lambda state, part: F.struct(
            F.when(state["start"], F.coalesce(part, F.lit("None")))
            .when(
                state["number"] & F.coalesce(part.rlike(number), F.lit(False)),
                F.concat(state["text"], F.lit("."), part),
            )
            .otherwise(F.concat(state["text"], F.lit(divider), F.coalesce(part, F.lit("None"))))
            .alias("text"),
            F.coalesce(part.rlike(number), F.lit(False)).alias("number"),
            F.lit(False).alias("start"),
        ),
    )
    text = F.trim(folded["text"])
    if verse is None:
        return text
    return F.when(
        F.length(verse) > 0, F.concat(text, F.when(text.contains("."), ".").otherwise(":"), verse)
    ).otherwise(text)


def section_text(path: Column, title_path: Column) -> Column:
    """Every way to name a division: its own and its ancestors' descriptions, by descriptor and by title."""
    depth = F.size(path)
    levels = F.transform(F.sequence(F.lit(1), depth), lambda i: depth - i + 1)
    both = F.flatten(
        F.transform(
            levels,
            lambda n: F.array(describe_path(F.slice(path, 1, n)), describe_path(F.slice(title_path, 1, n))),
        )
    )
    return F.array_join(both, ",")


def verse_label(indicator: Column, sequence_number: Column) -> Column:
    return F.coalesce(F.when(F.length(indicator) > 0, indicator), sequence_number.cast("string"))
