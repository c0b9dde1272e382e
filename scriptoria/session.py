"""Session defaults, and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(app: str = "scriptoria", cores: str = "8", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own settings."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {
        **_LOCAL_DEFAULTS,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "12g",
        "scriptoria.scan.tasks": str(cores),
        **conf,
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = context.getCheckpointDir() or os.path.join(tempfile.mkdtemp(prefix="scriptoria-"), "checkpoint")
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably in the shared folder.

    Used where one expensive stage (parsing XML in Python, running counts over
    a corpus) feeds several consumers.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored_columns(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as compressed columns, for wide tables with long texts.

    A checkpoint writes every row in full and not compressed, and its readers
    read all columns.
    """
    path = f"{shared_folder(df.sparkSession)}/columns-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that sorts and merges, never sent whole to the driver and from there to every task.

    For sides that grow with the input where Spark's estimate is far too small:
    it goes by the size of compressed files, or of what was stored before.
    """
    return df.hint("merge")


# Rows of a stored table up to which it goes whole to every task.
_SMALL_ROWS = 20_000


def few_rows(stored: DataFrame) -> bool:
    """Whether a stored table has few enough rows to go whole to every task."""
    return stored.limit(_SMALL_ROWS + 1).count() <= _SMALL_ROWS


def small_or_merged(df: DataFrame) -> DataFrame:
    """``df``, stored, as a side of a join with something large: sent to every task if it has few rows, else ``merged``."""
    stored = cut_lineage(df)
    return F.broadcast(stored) if few_rows(stored) else merged(stored)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a scan out to as many tasks as ``scriptoria.scan.tasks`` says; unset, as on a cluster, it stays as it is.

    A local session sets it: a test table is one row group, which one task reads.
    """
    tasks = df.sparkSession.conf.get("scriptoria.scan.tasks", None)
    return df.repartition(int(tasks), *keys) if tasks else df


_SHIPPED = "_scriptoria_shipped"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context, so that functions find it from any working directory."""
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="scriptoria-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = folder / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    setattr(context, _SHIPPED, True)
