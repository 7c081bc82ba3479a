"""Streams with state of their own: order of time whatever the order of arrival, ends without a start, and a restart from the checkpoint."""

import datetime
import random

from presswire import streaming
from presswire.streaming import state

SCHEMA = "user long, ts timestamp, no long, kind string"
EPOCH = datetime.datetime(2026, 1, 1)


def micros(ts):
    return int((ts - datetime.datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def brute(rows, step):
    out, values = [], {}
    for user, ts, no, kind in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        values[user], (given, result), _ = step(values.get(user), micros(ts), kind)
        if given:
            out.append((user, no, result))
    return sorted(out, key=str)


def some(seed, n=300):
    rng = random.Random(seed)
    at = lambda: EPOCH + datetime.timedelta(minutes=rng.randrange(3000))
    return [(rng.choice([1, 2, 3, None]), at(), i, rng.choice(["start", "click", "error"])) for i in range(n)]


def test_restart_equals_one_run(spark, tmp_path):
    """Three runs of one checkpoint, a file of mixed times each; nothing is lost, repeated or taken out of order."""
    rows = some(1)
    parts = [rows[:100], rows[100:180], rows[180:]]
    source, table, log = (str(tmp_path / n) for n in ("source", "table", "log"))
    spark.createDataFrame([], SCHEMA).write.parquet(source)

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        out = state.folded(stream, "user", "ts", "no", "kind", state.timed(within=None), late="400 days")
        out.writeStream.format("parquet").option("path", table).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()

    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run()
    assert spark.read.schema("key long, no long, at long, result long").parquet(table).isEmpty()  # the watermark is far behind
    spark.createDataFrame([(None, datetime.datetime(2100, 1, 1), None, None)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run()
    got = sorted(((r["key"], r["no"], r["result"]) for r in spark.read.parquet(table).collect()), key=str)
    assert got == brute(rows, state.timed(None))
    assert any(r is None for *_, r in got) and any(r is not None for *_, r in got)


def test_to_the_end(spark, tmp_path):
    rows = some(2)
    spark.createDataFrame([*rows, (1, None, 999, "click")], SCHEMA).write.parquet(str(tmp_path / "events.parquet"))
    for step in (state.timed(60_000_000 * 60), state.spaced(60_000_000 * 45)):
        events = streaming.read(spark, str(tmp_path), "events")
        out = state.to_the_end(events, "ts", lambda s, step=step: state.folded(s, "user", "ts", "no", "kind", step, "400 days"))
        assert sorted(((r["key"], r["no"], r["result"]) for r in out.collect()), key=str) == brute(rows, step)


def test_steps():
    end = state.timed(within=100)
    assert end(None, 5, "click") == (None, (True, None), None)
    assert end(5, 50, "click") == (None, (True, 45), None) and end(5, 500, "click") == (None, (True, None), None)
    assert end(5, 7, "start") == (7, (False, None), 107)
    call = state.spaced(10)
    assert call(None, 5, "call") == (15, (True, 5), 15) and call(15, 6, "call") == (25, (True, 15), 25) and call(15, 60, "call") == (70, (True, 60), 70)
