"""Tab-separated Bibles: six-column files with book codes, and "Book 1:1 TAB text" lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions.normalize import normalize
from scriptoria.functions.strings import strip
from scriptoria.schemas import BOOK_NAMES
from scriptoria.sources.lines import windows_1252

# --- fixed value: "1 John 1:1 TAB text" -----------------------------------------
CITED_LINE = r"^((?:[0-9] )?[a-zA-Z ]+)([0-9]+)(?::([0-9]+))?\t(.*)"
# ---------------------------------------------------------------------------------


def parse_unbound(lines: DataFrame) -> DataFrame:
    """Six tab-separated cells per line; comment lines are dropped."""
    cells = F.split("value", "\t")
    names = ["book_index", "chapter", "verse", "subverse", "order_by", "text"]
    picked = [F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names)]
    kept = lines.where(~F.col("value").startswith("#"))
    keep = [c for c in lines.columns if c != "value"]
    return kept.select(*keep, *picked).withColumns(
        {"order_by": F.expr("try_cast(order_by AS bigint)"), "text": normalize(strip(F.col("text")))}
    )


def unbound_names(lines: DataFrame) -> DataFrame:
    """Work name from the "#name" comment: the text before the first bracket."""
    value = F.regexp_extract("value", "^#name[^\t]*\t([^\\[]+)", 1)
    keep = [c for c in lines.columns if c != "value"]
    return lines.where(F.col("value").startswith("#name")).select(*keep, F.trim(value).alias("name"))


def read_book_names(spark: SparkSession, path: str) -> DataFrame:
    """Book codes and names."""
    return spark.read.csv(path, sep="\t", schema=BOOK_NAMES, ignoreTrailingWhiteSpace=True)


def with_book_names(lines: DataFrame, book_names: DataFrame) -> DataFrame:
    """Inner join: a line of an unknown book is an error of the file, see ``unknown_books``."""
    return lines.join(book_names.select(F.col("code").alias("book_index"), F.col("name").alias("book")), "book_index")


def unknown_books(lines: DataFrame, book_names: DataFrame) -> DataFrame:
    return lines.join(book_names.select(F.col("code").alias("book_index")), "book_index", "left_anti")


def parse_cited_lines(lines: DataFrame, encoded_latin_1: bool = False) -> DataFrame:
    """Book, chapter, verse, text of "1 John 1:1 TAB text"; other lines (licences) are dropped."""
    value = windows_1252(F.col("value")) if encoded_latin_1 else F.col("value")
    rows = lines.withColumn("value", value).where(F.col("value").rlike(CITED_LINE))
    verse = F.regexp_extract("value", CITED_LINE, 3)
    return rows.withColumns(
        {
            "book": F.trim(F.regexp_extract("value", CITED_LINE, 1)),
            "chapter": F.regexp_extract("value", CITED_LINE, 2),
            "verse": F.when(verse != "", verse),
            "text": normalize(strip(F.regexp_extract("value", CITED_LINE, 4))),
        }
    ).drop("value")
