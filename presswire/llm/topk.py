"""Exact top-k inner products by norm-bucketed retrieval."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from presswire.llm.common import bucket, materialize, numbered, with_package

PACKED = "cls long, sub long, n int, ids binary, vectors binary"
SLACK = 1e-9  # relative; pruning by rounded bounds must never drop a row that ties


def usable(vector: str) -> Column:
    """Not null, and every component finite and not null."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(math.inf)))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def to_grid(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """row, id, vector: array<long> of floor(scale * component) in doubles, of each row; row tells rows apart that repeat an id.

    Rows with a null id and vectors that are null or hold null or non-finite components are left out.
    """
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("raw")).where(F.col("id").isNotNull() & usable("raw"))
    return numbered(rows.select("id", F.transform("raw", lambda x: F.floor(x.cast("double") * scale)).alias("vector")), "row")


def _matrix(vectors: pd.Series) -> np.ndarray:
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """A bucket as one row: ids are row numbers, then ids; vectors are held in the least width that fits, which their first byte tells."""
    frame = frame.sort_values(["norm", "id", "row"], ascending=[False, True, True])
    m = _matrix(frame["vector"])
    m = m.astype(next(t for t in (np.int16, np.int32, np.int64) if np.abs(m).max(initial=0) <= np.iinfo(t).max))
    ids = frame[["row", "id"]].to_numpy(dtype=np.int64).T
    return pd.DataFrame([(key[0], key[1], len(frame), ids.tobytes(), bytes([m.itemsize]) + m.tobytes())], columns=["cls", "sub", "n", "ids", "vectors"])


def _unpack(n: int, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers and ids: 2 x n, vectors)."""
    return np.frombuffer(ids, dtype=np.int64).reshape(2, n), np.frombuffer(vectors, dtype=f"i{vectors[0]}", offset=1).astype(np.int64).reshape(n, -1)


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact inner products; through floats (BLAS) while their sums stay below 2**53."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * q.shape[1]
    if bound < 2**53:
        return (q.astype(np.float64) @ p.T.astype(np.float64)).astype(np.int64)
    return q @ p.T


def search_bucket(q_ids, q, theta, p_ids, p, k: int, coordinate_from: float = 0.6, focus: int = 4):
    """(query, candidate id, score) with score >= theta[query] that can be among the query's k best of this bucket. q_ids, p_ids: row
    numbers and ids (2 x n); a row is no candidate of its own.

    p is sorted by falling length. A query's local threshold is the cosine that its theta asks of the longest vector: above 1 the
    bucket is skipped; from coordinate_from on, candidates are pruned by what the query's largest coordinates leave
    possible (Cauchy-Schwarz on the rest); below, by length, which is a prefix. All that remain get exact products.
    """
    width = max(q.shape[1], p.shape[1])
    q, p = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, p))
    q_len = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    p_len = np.sqrt((p.astype(np.float64) ** 2).sum(axis=1))
    need = np.divide(theta, q_len, out=np.full(len(q), -np.inf), where=q_len > 0)
    need -= np.abs(np.where(np.isfinite(need), need, 0)) * SLACK
    longest = p_len[0] if len(p_len) else 0.0
    local = np.divide(need, longest, out=np.full(len(q), -np.inf), where=longest > 0)
    out_q, out_id, out_score = [], [], []

    def keep(row: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ok = (scores >= theta[row]) & (ids[0] != q_ids[0][row])
        ids, scores = ids[1][ok], scores[ok]
        best = np.lexsort((ids, -scores))[:k]
        out_q.append(np.full(len(best), row)), out_id.append(ids[best]), out_score.append(scores[best])

    by_length = np.flatnonzero(local < coordinate_from)
    if len(by_length):
        prefix = np.searchsorted(-p_len, -need[by_length], side="right")
        scores = _products(q[by_length], p[: prefix.max()])
        for row, n, s in zip(by_length, prefix, scores, strict=True):
            keep(row, p_ids[:, :n], s[:n])
    by_coordinate = np.flatnonzero((local >= coordinate_from) & (local <= 1))
    if len(by_coordinate):
        unit = np.divide(p, p_len[:, None], out=np.zeros(p.shape), where=p_len[:, None] > 0)
        for row in by_coordinate:
            u = q[row] / q_len[row]
            at = np.argsort(-np.abs(u))[:focus]
            rest = math.sqrt(max(0.0, 1 - float((u[at] ** 2).sum())))
            part = unit[:, at]
            bound = part @ u[at] + rest * np.sqrt(np.maximum(0.0, 1 - (part**2).sum(axis=1)))
            ok = np.flatnonzero((bound + 1e-9) * p_len >= need[row])
            keep(row, p_ids[:, ok], _products(q[row : row + 1], p[ok])[0])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
    return join(out_q), join(out_id), join(out_score)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, ratio: float = 1.05, bucket_rows: int = 4096, query_rows: int = 512, seeds: int = 4) -> DataFrame:
    """Each query's k highest inner products with candidates of another row number: query_id, rank (from 1), vec_id, score.

    Both tables: row, id (longs), vector array<long>; a row number stands for one row in both. Candidates are grouped by length (within a
    factor ratio), and each group by hash into buckets of about bucket_rows; queries into blocks of about query_rows. The longest buckets
    give each query a threshold that k candidates reach; then every block meets the buckets whose length can still matter, in pairs joined
    on the bucket's key. A pair is one row, so no task holds more than its blocks, and buckets, the larger side, are sent once;
    only counts by length class (at most some 30,000 for doubles) reach the driver.

    Ties go to the smaller id. A query with fewer candidates than k gets them all. Rows that repeat an id are queries and candidates of
    their own. Vectors of unequal length count as padded with zeros. Empty tables give no rows.
    """
    spark = candidates.sparkSession
    with_package(spark)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    cls = F.when(F.col("norm") > 0, F.floor(F.log("norm") / math.log(ratio))).otherwise(F.lit(-1_000_000)).cast("long")
    rows = materialize(candidates.withColumn("norm", norm).withColumn("cls", cls))
    classes = sorted(((r["cls"], -(-r["n"] // bucket_rows)) for r in rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    subs = T.StructType([T.StructField("cls", T.LongType()), T.StructField("subs", T.LongType())])
    subs_df = F.broadcast(spark.createDataFrame(classes, subs))
    buckets = rows.join(subs_df, "cls").withColumn("sub", bucket(F.col("subs"), "row", seed=1)).select("cls", "sub", "norm", "row", "id", "vector")
    buckets = materialize(buckets.groupBy("cls", "sub").applyInPandas(_pack, PACKED))

    asked = queries.withColumn("norm", norm)
    blocks = max(1, -(-asked.count() // query_rows))
    blocks_df = asked.withColumns({"cls": F.lit(0).cast("long"), "sub": bucket(blocks, "row", seed=2)}).select("cls", "sub", "norm", "row", "id", "vector").groupBy("cls", "sub").applyInPandas(_pack, PACKED)
    blocks_df = materialize(blocks_df.select(F.col("sub").alias("block"), F.col("n").alias("qn"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")))

    # Thresholds: in each of the longest buckets a query's k-th best score; the highest of these is one that k rows reach.
    first = [(c, s) for c, n in classes[:seeds] for s in range(min(n, seeds))][:seeds]
    first_df = spark.createDataFrame(first, T.StructType([T.StructField("cls", T.LongType()), T.StructField("sub", T.LongType())]))
    key_list = F.array(*[F.struct(F.lit(c).cast("long").alias("cls"), F.lit(s).cast("long").alias("sub")) for c, s in first]) if first else F.array().cast("array<struct<cls:bigint,sub:bigint>>")
    seed_buckets = buckets.join(F.broadcast(first_df), ["cls", "sub"], "left_semi")

    def seed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                q_ids, q = _unpack(r.qn, r.q_ids, r.q_vectors)
                p_ids, p = _unpack(r.n, r.ids, r.vectors)
                row, _, score = search_bucket(q_ids, q, np.full(len(q), -np.inf), p_ids, p, k)
                theta = np.full(len(q), -np.inf)
                count = np.bincount(row, minlength=len(q))
                np.minimum.at(low := np.full(len(q), np.inf), row, score)
                theta[count >= k] = low[count >= k]
                out.append((r.block, theta.tobytes()))
            yield pd.DataFrame(out, columns=["block", "theta"])

    seeded = blocks_df.withColumn("key", F.explode(key_list)).select("*", "key.cls", "key.sub").drop("key").join(seed_buckets, ["cls", "sub"]).mapInPandas(seed, "block long, theta binary")
    seeded = materialize(seeded.groupBy("block").agg(F.collect_list("theta").alias("thetas")))  # at most `seeds` a block

    # Each block meets the buckets of the classes that can hold a vector long enough for one of its queries.
    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                q_ids, q = _unpack(r.qn, r.q_ids, r.q_vectors)
                theta = np.full(len(q), -np.inf)
                for t in r.thetas if r.thetas is not None else []:
                    theta = np.maximum(theta, np.frombuffer(t))
                q_len = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
                need = np.divide(theta, q_len, out=np.full(len(q), -np.inf), where=q_len > 0).min(initial=np.inf)
                for c, n in classes:
                    if c == -1_000_000 or ratio ** (c + 1) * (1 + SLACK) >= need or need <= 0:
                        out.extend((r.block, c, s, theta.tobytes()) for s in range(n))
            yield pd.DataFrame(out, columns=["block", "cls", "sub", "theta"])

    pairs = blocks_df.join(seeded, "block", "left").mapInPandas(reach, "block long, cls long, sub long, theta binary")
    pairs = pairs.join(blocks_df, "block").join(buckets, ["cls", "sub"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                q_ids, q = _unpack(r.qn, r.q_ids, r.q_vectors)
                p_ids, p = _unpack(r.n, r.ids, r.vectors)
                row, ids, score = search_bucket(q_ids, q, np.frombuffer(r.theta), p_ids, p, k)
                yield pd.DataFrame({"query": q_ids[0][row], "query_id": q_ids[1][row], "vec_id": ids, "score": score})

    found = pairs.mapInPandas(search, "query long, query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
