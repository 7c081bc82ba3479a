"""Connected components and link counts for near-duplicate groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswire.llm.common import materialize


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """id, component (the smallest id reachable) of the ends of edges (a, b: long). Ids without edges are not returned.

    Alternates large-star and small-star: each node's larger neighbours, then its smaller ones, are linked to the smallest
    neighbour. Edges stay at most as many as at the start. The minima are partial aggregates, written before they are joined: a
    join of two shuffled sides is one whose hot keys (hubs) adaptive execution splits. Rounds grow with the logarithm of the longest
    path; components that are not whole after max_rounds raise RuntimeError and are never returned.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, before = materialize(pairs), None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        pairs = materialize(small.where("u <> v").distinct())
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components are not whole after {max_rounds} rounds")
    stars = pairs.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("id"), "component").unionByName(stars.select(F.col("component").alias("id"), "component").distinct())


def sized(members: DataFrame, key: str = "component") -> DataFrame:
    """members with the number of rows of their key (members). The counts are written first, so that hot keys of the join can be split."""
    counts = materialize(members.groupBy(key).agg(F.count(F.lit(1)).alias("members")))
    return members.join(counts, key)


def blocks(rows: DataFrame, block_rows: int, bin_rows: int) -> DataFrame:
    """sized() rows (id, component, members, ...) dealt to tasks so that any two members of a component meet in exactly one of them.

    A component of up to block_rows goes whole to a bin with others. A larger one is cut into blocks by hash of id, and a
    row goes to each pair of blocks that its own belongs to. Adds: task (long), side_a, side_b (the pair's blocks; equal for
    a block with itself), block (the row's own).
    """
    n_bins = max(1, -(-rows.count() // bin_rows))
    cut = F.ceil(F.col("members") / block_rows).cast("int")
    rows = rows.withColumn("n_blocks", cut).withColumn("block", F.pmod(F.xxhash64(F.lit(7), "id"), F.col("n_blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("side_a"), F.greatest(o, F.col("block")).alias("side_b")))
    rows = rows.withColumn("pair", F.explode(pairs)).select("*", "pair.side_a", "pair.side_b").drop("pair")
    task = F.when(F.col("n_blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(n_bins))).otherwise(n_bins + F.pmod(F.xxhash64("component", "side_a", "side_b"), F.lit(2**40)))
    return rows.withColumn("task", task).drop("members", "n_blocks")
