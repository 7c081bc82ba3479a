"""Components and buckets where they grow: long paths, and many buckets that do not occur."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswire.llm import graph, suffixes


def test_chain_of_100000_nodes(spark):
    """One component as long as can be, its ids in mixed order along the path."""
    n = 100_000
    name = lambda i: F.pmod(i * 7919, F.lit(n))  # noqa: E731  a permutation, for 7919 and n have no common divisor
    edges = spark.range(n - 1).select(name(F.col("id")).alias("a"), name(F.col("id") + 1).alias("b"))
    got = graph.components(edges)
    assert got.count() == n and got.where("component <> 0").isEmpty()


def test_unfinished_components_raise(spark):
    edges = spark.range(2000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    with pytest.raises(RuntimeError, match="not whole"):
        graph.components(edges, max_rounds=2)


def test_buckets_that_do_not_occur_cost_nothing():
    key = np.random.default_rng(1).integers(0, 2**63, size=5000).astype(np.uint64)
    start = time.time()
    for n in (3, 100_000, 10**12):
        rows = dict(suffixes.by_bucket(key, n, np.arange(5000)))
        assert sum(map(len, rows.values())) == 5000 and all((key[r] % np.uint64(n) == b).all() and (np.diff(r) > 0).all() for b, r in rows.items())
    assert time.time() - start < 1
    assert not list(suffixes.by_bucket(key[:0], 10, np.arange(0)))
