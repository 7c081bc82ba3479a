"""The keyword join against a nested loop over both sides."""

import random

import pytest

from presswire.operators import keyword_join


def pairs(rows, words):
    return sorted(((i, k) for i, t in rows if t is not None for k in {w.lower() for w in words if w is not None} if k in t.lower()), key=str)


@pytest.mark.parametrize("hot", [1, 10, 1_000_000])
def test_equals_nested_loop(spark, hot):
    """hot = 1: every gram is dealt to several tasks."""
    rng = random.Random(hot)
    letters = "aaabcdeÉ😀 .'%\n"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 40)))) for i in range(300)] + [(300, None), (301, ""), (5, "abc"), (5, "abc"), (None, "ABCDE")]
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(120)] + ["AbC", "abc", None, "zzz", "É", "😀", "a"]
    for some in (words, [*words, ""], [""], ["zz"], [None]):
        items = spark.createDataFrame(rows, "id long, text string")
        got = keyword_join.contained_keywords(items, "text", spark.createDataFrame([(w,) for w in some], "k string"), "k", hot)
        assert sorted(((r["id"], r["k"]) for r in got.collect()), key=str) == pairs(rows, some)


def test_columns_that_clash(spark):
    items = spark.createDataFrame([(1, "a cat", "x", "y")], "id long, text string, _gram string, k string")
    got = keyword_join.contained_keywords(items, "text", spark.createDataFrame([("CAT",)], "k string"), "k")
    assert got.columns == ["id", "text", "_gram", "k"] and [tuple(r) for r in got.collect()] == [(1, "a cat", "x", "cat")]
    assert keyword_join.contained_keywords(items.limit(0), "text", spark.createDataFrame([("CAT",), ("",)], "k string"), "k").isEmpty()


def test_hot_gram_is_dealt_to_many_tasks(spark):
    """All texts hold the one keyword: no task of the join gets them all, whatever adaptive execution does."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        items = spark.range(4000).selectExpr("id", "concat('always ', id) as text")
        got = keyword_join.contained_keywords(items, "text", spark.createDataFrame([("always",)], "k string"), "k", hot=500)
        sizes = got.selectExpr("spark_partition_id() as p").groupBy("p").count().collect()
        assert sum(r["count"] for r in sizes) == 4000
        assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
        assert len(sizes) > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
