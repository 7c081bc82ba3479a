"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from presswire.llm.common import bucket, materialize, numbered, row_keys, small, with_nth

WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """Words that each source gives: share of all words dealt by weight, none above cap times its size, excess reshared.

    Weights repeat over the sources in code point order, null last.
    """
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out = {s: 0.0 for s in names}
    left, open_ = share * sum(sizes.values()), [s for s in names if sizes[s] > 0]
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > cap * sizes[s]]
        if not over:
            out |= {s: unit * weight[s] for s in open_}
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def split_quotas(quotas: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard: (shards, sources); the columns add up to the quotas.

    Each node of the tree gives its left half of the shards a multivariate-hypergeometric draw from the quotas, its
    right half the rest.
    """
    out = np.zeros((n_shards, len(quotas)), dtype=np.int64)
    if not sum(quotas):
        return out

    def split(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        take = int(have.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(have, take, method="marginals")
        split(lo, mid, left)
        split(mid, hi, have - left)

    split(0, n_shards, np.asarray(quotas, dtype=np.int64))
    return out


def mix(docs: DataFrame, n_shards: int = 16, n_blocks: int = 1024, seed: int = 11, keep: tuple[str, ...] = (), weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Mix the sources of docs (doc_id, text, source) to their targets; a row of docs is taken 0, 1 or 2 times.

    A source's rows fall into n_blocks blocks by a hash of doc_id, text and, where both repeat, the row's place among its equals; so block
    order is a random permutation that reruns repeat, and no doc_id fills a block. A source gives as many full passes as its target
    holds; of the next pass it gives whole blocks in order while they fit, then sub-blocks of the next block, then single
    rows of the next sub-block, so that the sum stops within a row or so of the target. Block quotas are dealt to
    output shards by split_quotas(); a shard takes disjoint runs of each source's block order. Sort a shard by order_key to shuffle it
    locally.

    Per-source totals and block quotas (sources x shards numbers) are all that reaches the driver, so sources should number some
    100,000 at most. Tables by source and block are broadcast only if they are small().
    Returns doc_id, the columns in keep, source, size (words), source_size, target, taken (words, repeats counted),
    copies: array of struct(shard, order_key), one for each time the row is taken.
    Null text: size 0; null source: a source, last in order; sources without words give nothing; an empty table gives no
    rows; rows that repeat a doc_id, or have none, are rows of their own; other columns are ignored.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    key_a, key_b = row_keys(["doc_id", "source", "text"])
    rows = with_nth(numbered(docs.select("doc_id", *keep, "source", size.alias("size"), key_a.alias("key_a"), key_b.alias("key_b")), "row"), "row")
    rows = rows.withColumns({"block": bucket(n_blocks, "key_a", "nth", seed=seed).cast("int"), "sub_block": bucket(n_blocks, "key_a", "nth", seed=seed + 1).cast("int")})
    narrow = rows.drop(*keep)
    sizes = {r["source"]: r["words"] for r in narrow.groupBy("source").agg(F.sum("size").alias("words")).collect()}
    targets = source_targets(sizes, weights, share, cap)
    plan = []
    for s, target in targets.items():
        passes = min(int(cap), int(target // sizes[s])) if sizes[s] else 0
        plan.append((s, sizes[s], float(target), passes, float(target - passes * sizes[s])))
    plan_schema = T.StructType([T.StructField("plan_source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("passes", T.IntegerType()), T.StructField("rest", T.DoubleType())])
    plans = spark.createDataFrame(plan, plan_schema)

    # Blocks of a source in order: taken in the last pass while the running sum fits, the one that crosses is cut further.
    blocks = narrow.groupBy("source", "block").agg(F.sum("size").alias("words")).join(plans, F.col("source").eqNullSafe(F.col("plan_source")))
    by_source = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("words").over(by_source) - F.col("words")
    blocks = materialize(
        blocks.withColumn("before", before).withColumn(
            "state", F.when((F.col("before") + F.col("words") <= F.col("rest")) & (F.col("rest") > 0), "whole").when(F.col("before") < F.col("rest"), "cut").otherwise("out")
        )
    )
    edge_blocks = materialize(blocks.where("state = 'cut'").select(F.col("source").alias("e_source"), F.col("block").alias("e_block"), "before", "rest"))  # one a source
    in_edge = narrow.join(small(edge_blocks), F.col("source").eqNullSafe(F.col("e_source")) & (F.col("block") == F.col("e_block")))
    in_edge = materialize(in_edge.select("row", "source", "key_a", "nth", "size", "sub_block", "before", "rest"))
    subs = in_edge.groupBy("source", "sub_block", "rest").agg(F.sum("size").alias("words"), F.first("before").alias("base"))
    sub_before = F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("sub_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    sub_state = F.when(F.col("sub_before") + F.col("words") <= F.col("rest"), "whole").when(F.col("sub_before") < F.col("rest"), "cut").otherwise("out")
    subs = materialize(subs.withColumn("sub_before", sub_before).select(F.col("source").alias("s_source"), F.col("sub_block").alias("s_block"), "sub_before", F.col("rest").alias("s_rest"), sub_state.alias("sub_state")))

    # Quotas: each pass over a source draws its blocks; the tree deals them to the shards.
    drawn = blocks.withColumn("draws", F.col("passes") + (F.col("state") != "out").cast("int")).where("draws > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("draws") - 1)))
    drawn = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("pass", "block")))
    names = list(targets)
    quota = {r["source"]: r["n"] for r in drawn.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    dealt = split_quotas([quota.get(s, 0) for s in names], n_shards, seed)
    ends = np.cumsum(dealt, axis=0)
    runs = [(s, j, int(ends[j, i] - dealt[j, i]), int(ends[j, i])) for i, s in enumerate(names) for j in range(n_shards) if dealt[j, i]]
    run_schema = T.StructType([T.StructField("r_source", T.StringType()), T.StructField("shard", T.IntegerType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])
    runs_df = spark.createDataFrame(runs, run_schema)
    dealt_blocks = (
        drawn.join(runs_df, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("rank") > F.col("lo")) & (F.col("rank") <= F.col("hi")))
        .groupBy("source", "block")
        .agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("draws"))
    )
    block_plan = (
        blocks.alias("b")
        .join(dealt_blocks.alias("d"), F.col("b.source").eqNullSafe(F.col("d.source")) & (F.col("b.block") == F.col("d.block")), "left")
        .select(F.col("b.source").alias("p_source"), F.col("b.block").alias("p_block"), "source_size", "target", "passes", "state", "draws")
    )
    out = rows.join(small(materialize(block_plan)), F.col("source").eqNullSafe(F.col("p_source")) & (F.col("block") == F.col("p_block")))
    out = out.join(small(subs), (F.col("state") == "cut") & F.col("source").eqNullSafe(F.col("s_source")) & (F.col("sub_block") == F.col("s_block")), "left")
    # Single rows of the one sub-block in which a source's sum crosses its target: taken while that brings the sum nearer.
    leaf = in_edge.join(small(materialize(subs.where("sub_state = 'cut'"))), F.col("source").eqNullSafe(F.col("s_source")) & (F.col("sub_block") == F.col("s_block")))
    leaf_before = F.col("sub_before") + F.sum("size").over(Window.partitionBy("source").orderBy("key_a", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    leaf = materialize(leaf.withColumn("leaf_before", leaf_before).where(F.col("leaf_before") + F.col("size") / 2 <= F.col("s_rest")).select(F.col("row").alias("l_row"), F.lit(True).alias("l_taken")))
    out = out.join(small(leaf), (F.col("sub_state") == "cut") & (F.col("row") == F.col("l_row")), "left")
    last = F.when(F.col("state") == "whole", True).when(F.col("state") == "cut", (F.col("sub_state") == "whole") | F.coalesce(F.col("l_taken"), F.lit(False))).otherwise(False)
    times = F.col("passes") + F.coalesce(last, F.lit(False)).cast("int")
    draws = F.slice(F.coalesce(F.col("draws"), F.array().cast("array<struct<pass:int,shard:int>>")), F.lit(1), times)
    copies = F.transform(draws, lambda d: F.struct(d["shard"].alias("shard"), F.xxhash64(F.lit(seed), d["pass"], F.col("key_a"), F.col("nth")).alias("order_key")))
    return out.select("doc_id", *keep, "source", "size", "source_size", "target", (F.col("size") * times).alias("taken"), copies.alias("copies"))
