"""Chunked operators against plain windows, with one hot group and tiny chunks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptoria.operators import navigation as N
from scriptoria.operators import ordered as O


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    orders = rng.sample(range(5000), 600)
    data = [("hot" if i % 3 else f"g{i % 7}", o, rng.choice([None, i]), i % 5) for i, o in enumerate(orders)]
    return spark.createDataFrame(data, "g string, o long, v long, n int").repartition(5)


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("width", [1, 13, 100000])
def test_running_sum_and_numbers(rows, width):
    got = O.running_sum(rows, ["g"], "o", {"s": F.col("n").cast("long")}, O.by_width("o", width), {"s": "total"})
    got = O.number_rows(got, ["g"], "o", "p", O.by_width("o", width))
    w = Window.partitionBy("g").orderBy("o")
    want = rows.select("*", F.sum("n").over(w).alias("s"), F.sum("n").over(Window.partitionBy("g")).alias("total"), F.row_number().over(w).cast("long").alias("p"))
    same(got.select("g", "o", "s", "total", "p"), want.select("g", "o", "s", "total", "p"))


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("width", [1, 17, 100000])
def test_carry(rows, backward, inclusive, width):
    got = O.carry(rows, ["g"], "o", {"c": F.col("v")}, backward, inclusive, O.by_width("o", width))
    w = Window.partitionBy("g").orderBy(F.desc("o") if backward else F.asc("o")).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = rows.select("g", "o", F.last("v", ignorenulls=True).over(w).alias("c"))
    same(got.select("g", "o", "c"), want)


@pytest.mark.parametrize("tile", [4, 5, 1000])
def test_halo_window(rows, tile):
    placed = O.number_rows(rows, ["g"], "o", "p")
    got = O.halo_window(placed, ["g"], "p", 3, 4, lambda w: {"l": F.collect_list("o").over(w.rowsBetween(-3, 4))}, tile)
    w = Window.partitionBy("g").orderBy("o").rowsBetween(-3, 4)
    same(got.select("g", "o", "l"), rows.select("g", "o", F.collect_list("o").over(w).alias("l")))


def test_page_strip_shape(spark):
    chapters = spark.createDataFrame([("w", i, None, i) for i in range(1, 13)], "work_slug string, division_id long, parent_id long, sequence_number long")
    strips = {r.division_id: r.strip for r in N.page_strip(chapters, tile=5).collect()}
    assert strips[6] == [3, 4, 5, 6, 7, 8, 9, 10]
    assert strips[1] == [1, 2, 3, 4, 5]
    assert strips[12] == [9, 10, 11, 12]
