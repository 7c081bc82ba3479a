"""What the corpus operators share: lineage cuts in the cluster's shared folder, and reading tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswire.session import with_package as with_package


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session, as in tests, may leave the setting out; it then gets a folder under /tmp/checkpoints.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/checkpoints/presswire"


_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def written() -> Iterator[list[str]]:
    """The paths of the tables that materialize() writes inside the block, in order."""
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield paths
    finally:
        _written.reset(token)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that no DataFrame in use reads any more."""
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back.

    Unlike a local checkpoint the files outlive an executor. Parquet keeps them small and prunes columns later. The tables stay
    until drop_tables() or the cluster's cleaning of the folder, since a returned DataFrame may read them at any time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (paths := _written.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_last(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """The result of build(), written; the tables that build() wrote on its way are dropped."""
    with written() as paths:
        out = materialize(build())
    drop_tables(spark, paths[:-1])
    if (outer := _written.get()) is not None:
        outer.append(paths[-1])
    return out


def free_name(df: DataFrame, stem: str = "_row") -> str:
    """A name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, written, with a number for each row: what tells rows apart that repeat an id, or have none. Written numbers stay as they are
    when an executor is lost; where rows come in another order they are others."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()))


def row_keys(columns: list[str]) -> list[Column]:
    """Two hashes of 64 bits that rows have in common if they are equal in all of the columns, nulls included."""
    nulls = [F.col(f"`{c}`").isNull() for c in columns]
    return [F.xxhash64(F.lit(seed), *nulls, *[F.col(f"`{c}`") for c in columns]) for seed in (101, 202)]


def with_nth(rows: DataFrame, row: str, keys: tuple[str, str] = ("key_a", "key_b")) -> DataFrame:
    """numbered() rows with nth: 0, 1, ... among the rows of equal keys (non-null longs).

    With nth even equal rows can be dealt to different tasks, and alike in every run. Rows whose keys occur once, in most tables all, get
    0 from one count. Others are numbered inside their part of the table (the row number's upper bits), behind the rows of the
    parts before it, so that no task holds a group, however often its row is repeated.
    """
    again = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys))
    if again.isEmpty():
        return rows.withColumn("nth", F.lit(0).cast("long"))
    some = rows.select(row, *keys).join(again, list(keys), "left_semi").withColumn("part", F.shiftright(row, 33))
    parts = materialize(some.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n")))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = materialize(parts.withColumn("before", F.coalesce(before, F.lit(0))).drop("n"))
    inside = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(row)) - 1
    nth = materialize(some.withColumn("inside", inside).join(parts, [*keys, "part"]).select(row, (F.col("before") + F.col("inside")).alias("nth")))
    return rows.join(nth, row, "left").withColumn("nth", F.coalesce("nth", F.lit(0)))


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """A written table as a join's side: broadcast if it has `most` rows at most, which is counted, else joined as Spark sees fit."""
    return F.broadcast(df) if df.count() <= most else df


def few(df: DataFrame, n: int, *keys: str, seed: int = 0) -> DataFrame:
    """About the n rows of least hash of the keys, never more; rows of equal keys count once. The same ones in every run.

    A bound on the hash, set by the number of rows, leaves some 2 n of them, so that no task gets n rows of every partition.
    """
    own, total = F.xxhash64(F.lit(seed), *keys), df.count()
    share = (2 * n + 100) / max(total, 1)
    if share < 1:
        df = df.where(own < F.lit(int(share * 2**64) - 2**63))
    return df.dropDuplicates(list(keys)).orderBy(own, *keys).limit(n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(n: int | Column, *keys: Column | str, seed: int = 0) -> Column:
    """A number from 0 to n-1 that depends on the keys and the seed alone."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.xxhash64(F.lit(seed), *keys), n)
