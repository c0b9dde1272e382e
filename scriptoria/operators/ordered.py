"""Order-dependent operators that survive a hot group.

A plain window puts a whole group into one task.  Here every group is cut into
chunks along its order; windows run inside a chunk, one summary row per chunk
is carried over the chunks of a group, and the two are joined on
(group, chunk).  The window inside a chunk and that join share one
partitioning, so the large side is shuffled once.

``chunk`` is a column that grows with the order (see ``by_width``); ``group``
columns must not be NULL.  The order must be unique inside a group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = "__chunk"
DEFAULT_WIDTH = 1 << 17


def by_width(order: Column | str, width: int = DEFAULT_WIDTH) -> Column:
    """Chunk of an integer order: at most ``width`` consecutive values share one."""
    order = F.col(order) if isinstance(order, str) else order
    return F.floor(order / F.lit(width)).cast("bigint")


def _order_columns(order: str | Column | Sequence[str | Column]) -> list[Column]:
    items = order if isinstance(order, (list, tuple)) else [order]
    return [F.col(c) if isinstance(c, str) else c for c in items]


def running_sum(
    df: DataFrame,
    group: Sequence[str],
    order: str | Sequence[str],
    values: dict[str, Column],
    chunk: Column | None = None,
    totals: dict[str, str] | None = None,
    exclusive: bool = False,
) -> DataFrame:
    """Add running sums of ``values`` (name -> integer column) along the order of each group.

    ``totals`` maps a value name to the name of a column holding the sum over
    the whole group.
    """
    group = list(group)
    keys = [*group, CHUNK]
    order_by = _order_columns(order)
    cut = df.withColumn(CHUNK, chunk if chunk is not None else by_width(order_by[0]))
    names = list(values)

    summary = cut.groupBy(*keys).agg(*[F.sum(values[n]).alias(f"__sum_{n}") for n in names])
    along = Window.partitionBy(*group).orderBy(CHUNK)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys,
        *[F.coalesce(F.sum(f"__sum_{n}").over(before), F.lit(0)).alias(f"__before_{n}") for n in names],
        *[
            F.sum(f"__sum_{n}").over(Window.partitionBy(*group)).alias(total)
            for n, total in (totals or {}).items()
        ],
    )
    local = Window.partitionBy(*keys).orderBy(*order_by)
    frame = local.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    inside = cut.select(
        "*", *[F.coalesce(F.sum(values[n]).over(frame), F.lit(0)).alias(f"__local_{n}") for n in names]
    )
    joined = inside.join(carried, keys)
    joined = joined.withColumns({n: F.col(f"__before_{n}") + F.col(f"__local_{n}") for n in names})
    return joined.drop(CHUNK, *[f"__{k}_{n}" for n in names for k in ("before", "local")])


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    order: str | Sequence[str],
    name: str = "position",
    chunk: Column | None = None,
    total: str | None = None,
) -> DataFrame:
    """Dense 1-based position along the order of each group (``row_number`` without the hot task)."""
    return running_sum(
        df, group, order, {name: F.lit(1).cast("bigint")}, chunk, {name: total} if total else None
    )


def carry(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    values: dict[str, Column],
    backward: bool = False,
    inclusive: bool = False,
    chunk: Column | None = None,
) -> DataFrame:
    """Nearest non-NULL value along the order.

    Looks at earlier rows, or at later ones with ``backward``; the row itself
    counts when ``inclusive``.  Lag, lead, fill and as-of look-ups are all this
    operator.
    """
    group = list(group)
    keys = [*group, CHUNK]
    cut = df.withColumn(CHUNK, chunk if chunk is not None else by_width(order))
    names = list(values)
    pick = F.min_by if backward else F.max_by
    summary = cut.groupBy(*keys).agg(
        *[
            pick(values[n], F.when(values[n].isNotNull(), F.col(order))).alias(f"__edge_{n}")
            for n in names
        ]
    )
    direction = F.col(CHUNK).desc() if backward else F.col(CHUNK).asc()
    before = Window.partitionBy(*group).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys, *[F.last(f"__edge_{n}", ignorenulls=True).over(before).alias(f"__carried_{n}") for n in names]
    )
    ordering = F.col(order).desc() if backward else F.col(order).asc()
    frame = (
        Window.partitionBy(*keys)
        .orderBy(ordering)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    inside = cut.select("*", *[F.last(values[n], ignorenulls=True).over(frame).alias(f"__local_{n}") for n in names])
    joined = inside.join(carried, keys)
    joined = joined.withColumns({n: F.coalesce(F.col(f"__local_{n}"), F.col(f"__carried_{n}")) for n in names})
    return joined.drop(CHUNK, *[f"__{k}_{n}" for n in names for k in ("carried", "local")])


def halo_window(
    df: DataFrame,
    group: Sequence[str],
    position: str,
    before: int,
    after: int,
    columns: Callable[[WindowSpec], dict[str, Column]],
    tile: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Row-frame windows over at most ``before`` earlier and ``after`` later rows.

    ``position`` is the dense position from ``number_rows``.  Rows near a tile
    edge are copied to the neighbouring tile, so each tile computes its own
    rows exactly; at most (before + after) rows per tile travel twice.
    """
    if tile < max(before, after):
        raise ValueError("a tile must be at least as long as the frame")
    home = F.floor((F.col(position) - 1) / F.lit(tile)).cast("bigint")
    offset = (F.col(position) - 1) % F.lit(tile)
    targets = F.filter(
        F.array(
            home,
            F.when((offset < after) & (home > 0), home - 1),
            F.when(offset >= tile - before, home + 1),
        ),
        lambda t: t.isNotNull(),
    )
    tiled = df.withColumn("__home", home).withColumn("__tile", F.explode(targets))
    window = Window.partitionBy(*group, "__tile").orderBy(position)
    out = tiled
    for name, column in columns(window).items():
        out = out.withColumn(name, column)
    return out.where(F.col("__home") == F.col("__tile")).drop("__home", "__tile")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], columns: Sequence[str]) -> DataFrame:
    """First row per key in the given order, by aggregation: a hot key is combined on the map side."""
    ranked = [c.alias(f"__o{i}") for i, c in enumerate(_order_columns(list(order)))]
    row = F.struct(*columns).alias("__row")
    return (
        df.groupBy(*keys)
        .agg(F.min(F.struct(*ranked, row)).alias("__first"))
        .select(*keys, *[F.col(f"__first.__row.{c}").alias(c) for c in columns])
    )
