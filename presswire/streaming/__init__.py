"""Structured Streaming forms of the time-bound operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswire.operators.ordered import free_name


def read(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 8) -> DataFrame:
    """A table's files as a stream, files_per_trigger in a batch. A path that is a single file is read through a glob of its own name."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP; the tables hold TIMESTAMP_NTZ."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def folder(spark: SparkSession) -> str:
    """Where streams keep state and tables: spark.checkpoint.dir, which driver and executors share. Only a local session may leave it unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (shared or "/tmp/checkpoints/presswire").rstrip("/") + "/streams"


def temporary(spark: SparkSession, under: str) -> str:
    """A new folder under one that is shared; it goes when the driver's JVM ends, so what was read from it can be used until then."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{under}/{uuid.uuid4().hex}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return path.toString()


def drain(stream: DataFrame, mode: str, checkpoint: str, finish: Callable[[DataFrame], DataFrame] = lambda df: df, then: Callable[[], None] | None = None) -> DataFrame:
    """Run a stream over what is there, into tables in the checkpoint folder, and return their rows. Complete mode keeps the last batch's table.

    A batch has a table of its own number and overwrites it, so one that is run again after a failure adds nothing twice. With `then` the
    stream is taken up again from its checkpoint after that has been done.
    """
    home = temporary(stream.sparkSession, checkpoint)
    path, log = f"{home}/table", f"{home}/log"
    stream.sparkSession.createDataFrame([], stream.schema).write.parquet(f"{path}/batch=-1")  # so that there is a table without batches too

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={0 if mode == 'complete' else number}")

    for more in (then, None) if then else (None,):
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start()
        query.awaitTermination()
        if more:
            more()
    return finish(stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/batch=*"))


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events and their values by hour and type."""
    return (
        event_time(events)
        .withWatermark("ts", late)
        .groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("hour"), "event_type", "n", "total")
    )


def daily_spend(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Costs above 0 by day."""
    return (
        event_time(events)
        .withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day").alias("w"))
        .agg(F.sum(F.when(F.col("value") > 0, F.col("value")).otherwise(0.0)).alias("amount"))
        .select(F.to_date("w.start").alias("day"), "amount")
    )


def timed_and_untimed(rows: DataFrame, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Rows with an event time, for watermarks and windows, and those without: a null time is never late, but a watermark would drop it."""
    return rows.where(F.col(ts).isNotNull()), rows.where(F.col(ts).isNull())


def sliding(events: DataFrame, length: str = "1 hour", step: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    """Events by type in windows that overlap."""
    windows = event_time(events).withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return windows.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of a key's events without a gap of that length: key, start, end (gap included), n."""
    windows = event_time(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return windows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def paced(calls: DataFrame, key: str, ts: str, order: list[str], every: float) -> DataFrame:
    """When each call may start (starts, in seconds) if calls of a key start `every` seconds apart at least, none before it is asked for.

    The n-th call starts at the latest of asked[i] + (n - i) * every over the calls i up to n: a running maximum of asked - i * every. For keys
    that hold very many calls there is operators.scan.spaced, for streams state.spaced.
    """
    own, place = Window.partitionBy(key).orderBy(ts, *order), free_name(calls, "_place")
    asked = F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000
    rows = calls.withColumn(place, F.row_number().over(own) - 1)
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("starts", F.max(asked - F.col(place) * every).over(upto) + F.col(place) * every).drop(place)


def first_seen(rows: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Rows whose keys were not seen within the watermark."""
    return event_time(rows, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def paired(starts: DataFrame, ends: DataFrame, key: str, within: str = "1 hour") -> DataFrame:
    """Stream-stream join of task starts and ends: key, started, ended, seconds. Ends without a start within the time give null."""
    a = event_time(starts, "started").withWatermark("started", "2 hours").alias("a")
    b = event_time(ends, "ended").withWatermark("ended", "2 hours").alias("b")
    on = F.expr(f"a.{key} = b.{key} and started <= ended and started >= ended - interval {within}")
    return b.join(a, on, "left_outer").select(F.col(f"b.{key}"), "ended", "started", (F.unix_seconds("ended") - F.unix_seconds("started")).alias("seconds"))
