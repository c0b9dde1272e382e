"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.session import shared_folder

# Rows and bytes of text handed to one call of a batch function; a longer text is a slice of its own.
SLICE_ROWS = 512
SLICE_BYTES = 4 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: columns that a consumer doesn't ask for are not read again."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def byte_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding it."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def map_slices(
    df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], dict | None], rows: int = SLICE_ROWS
) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows; ``fn`` returns the columns by name, in the schema's order.

    ``fn`` may keep state between calls (it is pickled once for each task).
    """
    kinds = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows):
                out = fn(part)
                if out is not None:
                    yield record(out, kinds)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut a batch where a slice has ``rows`` rows or its column ``text`` passes ``SLICE_BYTES``."""
    at = batch.schema.get_field_index("text")
    if at < 0:
        yield from (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))
        return
    first = size = 0
    for k, length in enumerate(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()):
        if k > first and (k - first >= rows or size + length > SLICE_BYTES):
            yield batch.slice(first, k - first)
            first, size = k, 0
        size += length
    if first < batch.num_rows:
        yield batch.slice(first)


def record(columns: dict, kinds: pa.Schema) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=kinds.field(n).type) for n, c in columns.items()]
    return pa.RecordBatch.from_arrays(arrays, schema=pa.schema([kinds.field(n) for n in columns]))


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
