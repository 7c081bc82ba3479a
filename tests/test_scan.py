"""Scans over ranges against plain windows, with a key that holds all rows."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswire.operators import scan


@pytest.fixture
def ranges(spark):
    """Ranges stay small, as they are where there are many rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows(spark, keys):
    rng = random.Random(3)
    data = [(rng.choice(keys), rng.randrange(50), i, rng.choice([None, *range(-5, 20)])) for i in range(400)]
    return spark.createDataFrame(data, "k string, t int, i int, v long").repartition(3)


@pytest.mark.parametrize("keys", [["one"], ["a", "b", None], [f"k{i}" for i in range(100)]])
@pytest.mark.parametrize("own", [True, False])
def test_equals_window(ranges, keys, own):
    df = rows(ranges, keys)
    over = Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    want = {r["i"]: (r["s"], r["m"], r["l"]) for r in df.select("i", F.sum("v").over(over).alias("s"), F.max("v").over(over).alias("m"), F.last("v", ignorenulls=True).over(over).alias("l")).collect()}
    dealt = scan.Ranges(df, ["k"], ["t", "i"])
    sizes = [r["count"] for r in dealt.rows.groupBy(dealt.part).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 200
    for operation, name in (("sum", "s"), ("max", "m"), ("last", "l")):
        dealt.running(F.col("v"), operation, name, own)
    assert {r["i"]: (r["s"], r["m"], r["l"]) for r in dealt.result().collect()} == want


def test_spaced(ranges):
    df = rows(ranges, ["one"])
    got = {r["i"]: r["at"] for r in scan.spaced(df, ["k"], ["t", "i"], F.col("t"), 3, "at").collect()}
    free = None
    for r in df.orderBy("t", "i").collect():
        at = r["t"] if free is None else max(r["t"], free)
        assert got[r["i"]] == at
        free = at + 3


def test_names_and_no_rows(ranges):
    df = ranges.createDataFrame([(1, 2, "x", "y")], "k int, t int, _part string, _carried string")
    out = scan.running(df, ["k"], ["t"], F.lit(1), "sum", "n")
    assert out.columns == [*df.columns, "n"] and [tuple(r) for r in out.collect()] == [(1, 2, "x", "y", 1)]
    assert scan.running(df.limit(0), ["k"], ["t"], F.lit(1), "sum", "n").isEmpty()
    assert scan.running(df, [], ["t"], F.lit(1), "sum", "n").count() == 1
