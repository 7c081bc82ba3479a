"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from presswire.llm.common import bucket, numbered, row_keys, with_nth

UNIT_SCHEMA = T.StructType([T.StructField("unit", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("first_slot", T.LongType())])
LARGE_SCHEMA = T.StructType([T.StructField("text_hash", T.LongType()), T.StructField("first_unit", T.LongType()), T.StructField("n_pieces", T.LongType())])


def place(vectors: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each unit. vectors: (units, dimensions), each dimension in shares of one shard's capacity.

    Largest units first; each goes where the dot product of its vector with what the shard has left is highest,
    among the shards it still fits in; when it fits in none, to the shard with most bytes (column 0) left.
    """
    left = np.ones((n_shards, vectors.shape[1]))
    out = np.zeros(len(vectors), dtype=np.int64)
    for i in np.lexsort((np.arange(len(vectors)), -vectors[:, 0])):
        v = vectors[i]
        fits = (left >= v - 1e-12).all(axis=1)
        score = left @ v if not fits.any() else np.where(fits, left @ v, -np.inf)
        out[i] = int(np.argmax(score)) if fits.any() else int(np.argmax(left[:, 0]))
        left[out[i]] -= v
    return out


def shard_documents(docs: DataFrame, n_shards: int = 24, cells_per_shard: int = 512, whole_share: float = 0.5) -> DataFrame:
    """Put documents into shards of near equal bytes; tokens and rows are balanced as far as that allows.

    A row's size is its text's UTF-8 bytes plus 8; tokens are runs of non-space. Groups are equal texts (by a 64-bit
    hash). Groups below the mean cell size are gathered into n_shards * cells_per_shard cells by hash; larger ones, at
    most as many, are units of their own. So the packing sees a number of units that the parameters bound, whatever the
    input, and those alone reach the driver. A group above whole_share of a shard's bytes is dealt in pieces; every
    other group stays in one shard. Pieces are dealt row by row, so a group splits whatever its doc_ids are.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (0, 1, ... in each shard), grown_shard (null), n_tokens.
    Null text counts as empty; empty table: no rows; rows that repeat a doc_id, or have none, are rows like others; other columns are
    ignored. Reruns agree.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key_a, key_b = row_keys(["doc_id", "text"])
    base = numbered(
        docs.select("doc_id", "text").select(
            "doc_id",
            (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("n_tokens"),
            F.xxhash64(text).alias("text_hash"),
            key_a.alias("key_a"),
            key_b.alias("key_b"),
        ),
        "row",
    )
    base = with_nth(base, "row")
    spark = docs.sparkSession
    total = base.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("rows")).first()
    cells = n_shards * cells_per_shard
    piece_rows = max(1, 4 * total["rows"] // cells)

    groups = base.groupBy("text_hash").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    large, first = [], cells
    whole: dict[int, tuple[int, int]] = {}  # first unit -> units of a group that stays together
    for g in sorted(groups.where(F.col("size") * cells > total["size"]).collect()):  # at most `cells` groups can be that large
        n = -(-g["rows"] // piece_rows)
        if g["size"] <= whole_share * total["size"] / n_shards:
            whole[first] = (first, n)
        large.append((g["text_hash"], first, n))
        first += n
    large_df = F.broadcast(spark.createDataFrame(large, LARGE_SCHEMA))
    rows = base.join(large_df, "text_hash", "left").withColumn(
        "unit", F.coalesce(F.col("first_unit") + bucket(F.col("n_pieces"), "key_a", "nth", seed=3), bucket(cells, "text_hash", seed=5))
    )

    units = sorted(rows.groupBy("unit").agg(F.sum("size"), F.sum("n_tokens"), F.count(F.lit(1))).collect())
    head = {u + i: u for u, (_, n) in whole.items() for i in range(n)}  # pieces of a whole group are placed as one
    keys = sorted({head.get(u[0], u[0]) for u in units})
    index = {k: i for i, k in enumerate(keys)}
    loads = np.zeros((len(keys), 3))
    for u in units:
        loads[index[head.get(u[0], u[0])]] += u[1:4]
    capacity = np.maximum(np.array([total["size"], total["tokens"], total["rows"]], dtype=float) / n_shards, 1.0)
    shard = place(loads / capacity, n_shards)
    start, placed = np.zeros(n_shards, dtype=np.int64), []
    for u in units:
        s = int(shard[index[head.get(u[0], u[0])]])
        placed.append((u[0], s, int(start[s])))
        start[s] += u[3]
    placed_df = F.broadcast(spark.createDataFrame(placed, UNIT_SCHEMA))  # bounded as the units are
    inside = Window.partitionBy("unit").orderBy("key_a", "nth")  # a unit is a cell's rows or a piece's
    return (
        rows.withColumn("place", F.row_number().over(inside))
        .join(placed_df, "unit")
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("first_slot") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "n_tokens",
        )
    )
