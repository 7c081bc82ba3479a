"""Ball k-means against plain rounds over all centroids, on vectors where ties are common."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswire.llm import balls


def brute(vectors, ids, k, rounds):
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, hashlib.sha256(f"1:{ids[i]}".encode()).hexdigest(), vectors[i]))
    x, c = np.array(vectors, dtype=object), [np.array(vectors[i], dtype=object) for i in order[:k]]

    def assign():
        d = [[int(((v - m) ** 2).sum()) for m in c] for v in x]
        return [row.index(min(row)) for row in d], [min(row) for row in d]

    for _ in range(rounds):
        own, _ = assign()
        for j in range(len(c)):
            members = [x[i] for i in range(len(x)) if own[i] == j]
            if members:
                c[j] = np.array([sum(col) // len(members) for col in zip(*members, strict=True)], dtype=object)
    own, distance = assign()
    return own, distance, c


def check(spark, vectors, ids, k=5, rounds=3, scale=1):
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<double>")
    got = balls.cluster(balls.to_grid(df, width=len(vectors[0]), scale=scale), k, rounds).collect()
    grid = [[int(np.floor(v * scale)) for v in row] for row in vectors]
    own, distance, c = brute(grid, ids, k, rounds)
    inertia = {j: sum(d for d, o in zip(distance, own, strict=True) if o == j) for j in set(own)}
    want = [(i, o, d, inertia[o], sum(distance), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for i, o, d in zip(ids, own, distance, strict=True)]
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    return got


@pytest.mark.parametrize("seed", range(4))
def test_small_grids_with_ties(spark, seed):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-3, 4, size=(120, 3)).astype(float).tolist()
    check(spark, vectors, list(range(120)), k=7)


def test_clustered_vectors_skip_far_centroids(spark):
    """Far blobs: after the first round most vectors are compared with no other centroid."""
    rng = np.random.default_rng(1)
    vectors = (rng.integers(0, 6, size=(600, 1)) * 1000 + rng.normal(size=(600, 8))).tolist()
    got = check(spark, vectors, list(range(600)), k=6, rounds=4, scale=64)
    assert sum(r["compared"] == 0 for r in got) > 300


def test_repeated_and_null_ids_and_fewer_vectors_than_clusters(spark):
    check(spark, [[1.0, 2.0], [1.0, 2.0], [5.0, 5.0], [-4.5, 0.0]], [1, 1, 1, None], k=9)
    check(spark, [[0.0, 0.0]] * 3 + [[1.0, 0.0]] * 3, [3, 3, 3, 4, 4, 4], k=2)
    check(spark, [[2.0**20, -(2.0**20)], [2.0**20 - 1, 5.0], [0.0, 0.0]], [1, 2, 3], k=2, scale=64)


def test_what_takes_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.0] * 64), (2, None), (3, []), (4, [0.0] * 63), (5, [0.0] * 65), (6, [None] + [0.0] * 63), (7, [nan] + [0.0] * 63), (8, [inf] + [0.0] * 63), (9, [-0.01] + [0.0] * 63), (None, [1.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit("x"), "cluster": F.lit(1), "distance": F.lit(2)})
    assert {r["vec_id"] for r in balls.cluster(balls.to_grid(df)).collect()} == {1, 9, None}
    assert balls.cluster(balls.to_grid(df.limit(0))).isEmpty()
    assert balls.cluster(balls.to_grid(df.limit(0))).columns == balls.cluster(balls.to_grid(df)).columns
    with pytest.raises(Exception, match="beyond"):
        balls.cluster(balls.to_grid(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>"))).collect()


def test_neighbours_hold_every_centroid_that_can_matter():
    rng = np.random.default_rng(3)
    for _ in range(50):
        c = rng.integers(-20, 20, size=(8, 2))
        x = rng.integers(-25, 25, size=(200, 2))
        d = balls.squared(x, c)
        own = rng.integers(0, 8, size=200)
        radii = np.array([np.sqrt(d[own == i, i].max(initial=0)) for i in range(8)])
        cluster, distance, _ = balls.settle(x, own, c, balls.neighbours(c, radii))
        assert (cluster == d.argmin(1)).all() and (distance == d.min(1)).all()
