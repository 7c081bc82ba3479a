"""Ball k-means: exact rounds that compare a vector only with the centroids near its own cluster's ball."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswire.llm.common import drop_tables, materialize, with_package, written
from presswire.llm.topk import usable

MOST = 2**27  # components of the grid; squared distances of 64 such components still fit a long
STATE = "vec_id long, v array<int>, cluster int, distance long, compared int"


def to_grid(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", width: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, v: array<int> of floor(scale * component), in doubles, of vectors with exactly `width` components, none null or non-finite.

    Other rows are left out. Components beyond 2**27 on the grid raise an error, since distances would not fit their type.
    """
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).alias("raw")).where((F.size("raw") == width) & usable("raw"))
    grid = F.transform("raw", lambda x: F.floor(x.cast("double") * scale))
    wide = F.exists(grid, lambda g: (g > MOST) | (g < -MOST))
    return rows.select("vec_id", F.when(wide, F.raise_error(F.lit("a component is beyond 2**27 on the grid"))).otherwise(grid).cast("array<int>").alias("v"))


def seeds(grid: DataFrame, k: int) -> np.ndarray:
    """k vectors (all, if fewer) of the smallest sha256 of 1:<vec_id>, in that order; equal ids by their components, null ids last."""
    own = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    got = [r["v"] for r in grid.orderBy(own.asc_nulls_last(), "v").limit(k).collect()]
    return np.array(got, dtype=np.int64).reshape(len(got), len(got[0]) if got else 0)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows of x by rows of c (longs); through floats (BLAS) while every term stays below 2**53."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * top * top * c.shape[1] < 2**53:
        x, c = x.astype(np.float64), c.astype(np.float64)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)


def neighbours(centroids: np.ndarray, radii: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each ball the centroids that can be as near to one of its members as its own, nearest first, and their squared distances.

    A member at distance r from its own centroid c is at least |c - d| - r from d, so d matters only if |c - d| <= 2 r.
    """
    apart = squared(centroids, centroids)
    out = []
    for i, r in enumerate(radii):
        near = np.flatnonzero(apart[i] <= 4 * r * r * (1 + 1e-9) + 1)
        near = near[near != i]
        near = near[np.lexsort((near, apart[i][near]))]
        out.append((near, apart[i][near]))
    return out


def settle(x: np.ndarray, own: np.ndarray, centroids: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (ties: smaller number), its squared distance, and how many neighbours it was compared with.

    The stable core, nearer to the own centroid than half the way to the nearest neighbour, is compared with none. A vector of annulus t,
    between half the way to neighbour t and to neighbour t + 1, is compared with the first t.
    """
    cluster, distance, compared = own.copy(), np.empty(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int32)
    for i in np.unique(own):
        at = np.flatnonzero(own == i)
        distance[at] = squared(x[at], centroids[i : i + 1])[:, 0]
        others, apart = near[i]
        annulus = np.searchsorted(apart, 4 * distance[at], side="right")
        compared[at] = annulus
        for t in range(int(annulus.max(initial=0))):
            some, j = at[annulus > t], others[t]
            d = squared(x[some], centroids[j : j + 1])[:, 0]
            better = (d < distance[some]) | ((d == distance[some]) & (j < cluster[some]))
            distance[some[better]], cluster[some[better]] = d[better], j
    return cluster, distance, compared


def _frames(centroids: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]] | None):
    """Batches of vec_id, v (and cluster) to STATE; without near every centroid is compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
            if near is None:
                d = squared(x, centroids)
                cluster, compared = d.argmin(1), np.full(len(x), len(centroids), dtype=np.int32)
                distance = d[np.arange(len(x)), cluster]
            else:
                cluster, distance, compared = settle(x, batch.column("cluster").to_numpy().astype(np.int64), centroids, near)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(compared, pa.int32())], ["vec_id", "v", "cluster", "distance", "compared"])

    return run


def moved(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroids that follow (floor of the members' exact mean; empty clusters keep theirs), and a radius for each ball around them.

    Sums are Spark's, partial in each task; the driver gets one row for each cluster. The farthest member was at most the old radius
    from the old centroid, so it is at most that and the centroid's own move from the new one.
    """
    width = centroids.shape[1]
    sums = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(width)]
    out, radii = centroids.copy(), np.zeros(len(centroids))
    for r in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"), *sums).collect():
        i = r["cluster"]
        out[i] = [r[f"s{j}"] // r["n"] for j in range(width)]
        radii[i] = math.sqrt(r["far"]) + math.sqrt(sum((int(a) - int(b)) ** 2 for a, b in zip(out[i], centroids[i], strict=True)))
    return out, radii


def cluster(grid: DataFrame, k: int = 16, rounds: int = 3) -> DataFrame:
    """vec_id, cluster, distance (squared, to the own centroid), cluster_inertia, inertia, centroid_sha256, compared of to_grid() rows.

    Each round assigns every vector to its nearest centroid, ties to the smaller number, and moves the centroids to the exact floor of
    their members' mean; then vectors are assigned once more. Only the first assignment compares with all k; later ones only
    with the neighbours whose annulus a vector lies in, which gives the same result. compared is that number in the last one.

    Rows that repeat an id, or have none, are vectors of their own. Fewer than k vectors make fewer clusters; no vectors give no rows.
    A round writes vectors with their cluster and drops the round's before. What Python tasks are sent is k centroids and their
    neighbours: k is a parameter, some thousands at most.
    """
    spark = grid.sparkSession
    with_package(spark)
    centroids = seeds(grid, k)
    if not len(centroids):
        return grid.limit(0).select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"), F.lit(0).alias("compared"))
    with written() as paths:
        state = materialize(grid.mapInArrow(_frames(centroids, None), STATE))
        for _ in range(rounds):
            following, radii = moved(state, centroids)
            if (following == centroids).all():
                break  # every further round is this one
            centroids = following
            state = materialize(state.select("vec_id", "v", "cluster").mapInArrow(_frames(centroids, neighbours(centroids, radii)), STATE))
            drop_tables(spark, paths[-2:-1])
    sums = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(sums.values())
    rows = [(i, s, total, hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest()) for i, s in sums.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared")
