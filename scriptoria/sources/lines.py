"""Text files with line numbers, without reading a file in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.operators.ordered import number_rows


def read_lines(spark: SparkSession, path: str, start_line: int | None = None, encoding: str | None = None) -> DataFrame:
    """Lines of text files as file, line_no, value; optionally from a start line onward.

    A file may be split among tasks: rows are ordered by (file, block, row in
    the block), and line numbers are block sums plus the position in a block.
    """
    value = F.col("value")
    if encoding is not None:
        # The text source hands on the bytes of a line as they are.
        value = F.decode(value.cast("binary"), encoding)
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__row"),
        F.regexp_replace(value, "^﻿", "").alias("value"),
    )
    numbered = number_rows(raw, ["file"], "__row", "line_no", chunk=F.col("__block")).drop("__block", "__row")
    return from_line(numbered, start_line)


def from_line(lines: DataFrame, start_line: int | None) -> DataFrame:
    return lines if start_line is None else lines.where(F.col("line_no") >= start_line)


def map_lines(lines: DataFrame, hook: Callable[[int, str], Iterator[dict]], schema) -> DataFrame:
    """Run a Python hook per line in Arrow batches; it yields rows as dicts."""
    names = schema.fieldNames()

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [row for n, v in zip(batch["line_no"], batch["value"]) for row in hook(n, v)]
            yield pd.DataFrame([[row.get(c) for c in names] for row in rows], columns=names)

    return lines.select("line_no", "value").mapInPandas(run, schema)


# --- fixed values: the characters Windows-1252 has in place of the C1 controls ---
_C1_CODES = "80 82 83 84 85 86 87 88 89 8a 8b 8c 8e 91 92 93 94 95 96 97 98 99 9a 9b 9c 9e 9f"
_C1_CHARACTERS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
# ---------------------------------------------------------------------------------


def windows_1252(latin_1: Column) -> Column:
    """Latin-1 text re-read as Windows-1252."""
    return F.translate(latin_1, "".join(chr(int(c, 16)) for c in _C1_CODES.split()), _C1_CHARACTERS)
