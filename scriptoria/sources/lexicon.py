"""Headwords of lexicon articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def headwords(verses: DataFrame) -> DataFrame:
    """One row per text node of an ``orth`` element in a verse's markup."""
    return verses.select(
        "verse_id", "work_id", F.explode(F.xpath("original_content", F.lit("//orth/text()"))).alias("headword")
    )
