"""The library's own tables as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptoria.schemas import TABLES


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A library table with its declared schema; nothing is inferred."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def append_table(df: DataFrame, root: str, name: str) -> None:
    """Append rows in the declared column order and types."""
    columns = [df[f.name].cast(f.dataType).alias(f.name) if f.name in df.columns else None for f in TABLES[name]]
    missing = [f.name for f, c in zip(TABLES[name], columns) if c is None]
    if missing:
        raise ValueError(f"{name} lacks {missing}")
    df.select(*columns).write.mode("append").parquet(f"{root}/{name}")
