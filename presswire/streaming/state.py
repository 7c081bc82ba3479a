"""Streams with state of their own: each key's rows in order of time, whatever order they arrive in, folded into one value a key.

The state and its timers are Spark's (transformWithStateInPandas over RocksDB); a step is a small function over one row. Rows wait until the
watermark has passed them, so a key holds what arrived within the watermark's delay and no more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from presswire import streaming

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# value (None: nothing kept), at, kind -> value, what the row gives (None and False: no row), from when on the value no longer matters (None: never)
Step = Callable[[int | None, int, str], tuple[int | None, tuple[bool, int | None], int | None]]


def timed(within: int | None) -> Step:
    """Tasks: 'start' begins one anew, any other kind ends it and gives its length, or null without a start within so many microseconds."""

    def step(start: int | None, at: int, kind: str) -> tuple[int | None, tuple[bool, int | None], int | None]:
        if kind == "start":
            return at, (False, None), None if within is None else at + within
        return None, (True, at - start if start is not None and (within is None or at - start <= within) else None), None

    return step


def spaced(every: int) -> Step:
    """Calls: each gives the time at which it may start, `every` microseconds after the one before at the earliest."""

    def step(free: int | None, at: int, kind: str) -> tuple[int | None, tuple[bool, int | None], int | None]:
        begins = at if free is None else max(at, free)
        return begins + every, (True, begins), begins + every

    return step


class InOrder(StatefulProcessor):
    """A key's rows, in order of (at, no), through a step; its value is kept until it no longer matters."""

    def __init__(self, step: Step) -> None:
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, no long, kind string")
        self.value = handle.getValueState("value", "value long, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for frame in rows:
            frame = frame[frame["kind"].notna()]
            if len(frame):
                self.waiting.appendList([(int(a), int(n), k) for a, n, k in zip(frame["at"], frame["no"], frame["kind"], strict=True)])
                latest = max(int(frame["at"].max()), latest or 0)
        if latest is not None:
            self.handle.registerTimer(latest // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] < now], [r for r in rows if r[0] >= now]
        value, until = self.value.get() if self.value.exists() else (None, None)
        out = []
        for at, no, kind in due:
            value, (given, result), until = self.step(value, at, kind)
            if given:
                out.append((key[0], no, at, result))
        if later:
            self.waiting.put(later)
        elif rows:
            self.waiting.clear()
        if value is None or (until is not None and until < now and not due):
            self.value.clear()
        elif due:
            self.value.update((value, until))
            if until is not None:
                self.handle.registerTimer(max(until, now) // 1000 + 1)
        if out:
            yield pd.DataFrame({"key": [r[0] for r in out], "no": [r[1] for r in out], "at": [r[2] for r in out], "result": pd.array([r[3] for r in out], dtype="Int64")})


def folded(rows: DataFrame, key: str, ts: str, no: str, kind: str, step: Step, late: str = "1 hour") -> DataFrame:
    """key, no, at (microseconds), result (null where a step gives none) of a stream's rows with a time.

    Rows of a key are taken in order of time, then of no, once the watermark (`late` behind the newest row) has passed them; rows that come later than
    that are dropped, as everywhere on streams. Rows without kind only move the watermark. Rows without key are a key of their own.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed_rows = streaming.event_time(rows.select(F.col(key).cast("long").alias("key"), F.col(ts).alias("ts"), F.col(no).cast("long").alias("no"), F.col(kind).alias("kind")))
    stream = timed_rows.where(F.col("ts").isNotNull()).withColumn("at", F.unix_micros("ts")).withWatermark("ts", late)
    return stream.groupBy("key").transformWithStateInPandas(InOrder(step), "key long, no long, at long, result long", "Append", "EventTime")


def to_the_end(rows: DataFrame, ts: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run's result over a stream that ends, its last rows included.

    What the watermark has not passed when a stream ends would wait for ever. So the stream is run once as it is, and taken up again from its
    checkpoint with one more row, without kind and far in the future, that lets everything pass.
    """
    spark, home = rows.sparkSession, streaming.folder(rows.sparkSession)
    closing = f"{streaming.temporary(spark, home)}/closing"
    spark.createDataFrame([], rows.schema).write.parquet(closing)
    both = rows.unionByName(spark.readStream.schema(rows.schema).parquet(closing))
    last = [F.lit("2200-01-01").cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]
    return streaming.drain(run(both), "append", home, then=lambda: spark.range(1).select(*last).write.mode("append").parquet(closing))
