"""Streaming queries: run to completion over the events table; append mode keeps the last open windows out."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswire import streaming
from presswire.streaming import state


def stream_hourly(spark, sf_dir):
    out = streaming.drain(streaming.hourly(streaming.read(spark, sf_dir, "events")), "complete", streaming.folder(spark))
    return out.select(F.unix_seconds("hour").alias("hour_s"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_daily_spend(spark, sf_dir):
    out = streaming.drain(streaming.daily_spend(streaming.read(spark, sf_dir, "events")), "complete", streaming.folder(spark))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("amount", 4).alias("amount"))


def stream_dedupe(spark, sf_dir):
    """First event of each user and type within a watermark longer than the table."""
    events = streaming.read(spark, sf_dir, "events").select("ts", "user_id", "event_type")
    out = streaming.drain(streaming.first_seen(events, ["user_id", "event_type"], late="400 days"), "append", streaming.folder(spark))
    return out.select("user_id", "event_type")


def stream_task_timing(spark, sf_dir):
    """Starts (signup) and ends (click) of one user joined within an hour."""
    events = streaming.read(spark, sf_dir, "events")
    starts = events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("started"))
    ends = events.where("event_type = 'click'").select("user_id", F.col("ts").alias("ended"))
    a = streaming.event_time(starts, "started").withWatermark("started", "2 hours").alias("a")
    b = streaming.event_time(ends, "ended").withWatermark("ended", "2 hours").alias("b")
    on = F.expr("a.user_id = b.user_id and started <= ended and started >= ended - interval 1 hour")
    joined = a.join(b, on).select(F.col("a.user_id").alias("user_id"), (F.unix_micros("ended") - F.unix_micros("started")).alias("micros"))
    return streaming.drain(joined, "append", streaming.folder(spark)).select("user_id", "micros")


def stream_task_state(spark, sf_dir):
    """signup starts a task of its user, click and error end it: every end, those without a start too."""
    kind = F.when(F.col("event_type") == "signup", "start").otherwise(F.col("event_type"))
    events = streaming.read(spark, sf_dir, "events").where("event_type in ('signup', 'click', 'error')").select("user_id", "ts", "event_id", kind.alias("kind"))
    out = state.to_the_end(events, "ts", lambda rows: state.folded(rows, "user_id", "ts", "event_id", "kind", state.timed(30 * 86_400_000_000), "400 days"))
    return out.select(F.col("no").alias("event_id"), F.coalesce("result", F.lit(-1)).alias("micros"))


def stream_paced_state(spark, sf_dir):
    """Events as calls of their user (the provider) on a stream: when each may start, an hour apart."""
    events = streaming.read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.lit("call").alias("kind"))
    out = state.to_the_end(events, "ts", lambda rows: state.folded(rows, "user_id", "ts", "event_id", "kind", state.spaced(3_600_000_000), "400 days"))
    return out.select(F.col("no").alias("event_id"), F.round(F.col("result") / 1_000_000, 3).alias("starts"))


def stream_sliding(spark, sf_dir):
    """Extension: windows of an hour every quarter."""
    out = streaming.drain(streaming.sliding(streaming.read(spark, sf_dir, "events")), "complete", streaming.folder(spark))
    return out.select(F.unix_seconds("start").alias("start_s"), "event_type", "n")


def stream_sessions(spark, sf_dir):
    """Extension: a user's events with less than six hours between them."""
    rows = streaming.sessions(streaming.read(spark, sf_dir, "events"), "user_id", "6 hours", "400 days")
    out = streaming.drain(rows, "complete", streaming.folder(spark))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


def stream_null_times(spark, sf_dir):
    """Events whose time is unknown (every seventh) pass beside the watermark and count under no hour."""
    events = streaming.read(spark, sf_dir, "events").withColumn("ts", F.when(F.col("event_id") % 7 != 0, F.col("ts")))
    timed, untimed = streaming.timed_and_untimed(events)
    hours = streaming.drain(streaming.hourly(timed), "complete", streaming.folder(spark)).select(F.unix_seconds("hour").alias("hour_s"), "event_type", "n")
    rest = streaming.drain(untimed.select("event_type"), "append", streaming.folder(spark)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return hours.unionByName(rest.select(F.lit(-1).cast("long").alias("hour_s"), "event_type", "n"))


def paced_calls(spark, sf_dir):
    """Events as calls of their user (the provider): starts at least an hour apart."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts")
    return streaming.paced(rows, "user_id", "ts", ["event_id"], 3600.0).select("event_id", F.round("starts", 3).alias("starts"))


QUERIES = {
    "stream_hourly": (stream_hourly, "select epoch(date_trunc('hour', ts))::bigint as hour_s, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2"),
    "stream_daily_spend": (stream_daily_spend, "select strftime(ts, '%Y-%m-%d') as day, round(sum(case when value > 0 then value else 0 end), 4) as amount from events group by 1"),
    "stream_dedupe": (stream_dedupe, "select distinct user_id, event_type from events"),
    "stream_task_timing": (stream_task_timing, """select a.user_id, epoch_us(b.ts) - epoch_us(a.ts) as micros from events a join events b on a.user_id = b.user_id and a.event_type = 'signup' and b.event_type = 'click'
        and a.ts <= b.ts and a.ts >= b.ts - interval 1 hour"""),
    "stream_task_state": (stream_task_state, """with e as (select *, lag(event_type) over w as pt, lag(ts) over w as pts from events where event_type in ('signup', 'click', 'error') window w as (partition by user_id order by ts, event_id))
        select event_id, case when pt = 'signup' and pts >= ts - interval 30 day then epoch_us(ts) - epoch_us(pts) else -1 end as micros from e where event_type in ('click', 'error')"""),
    "stream_paced_state": (stream_paced_state, """with p as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events),
        m as (select *, max(epoch_us(ts) / 1000000 - i * 3600.0::double) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from p)
        select event_id, round(k + i * 3600.0::double, 3) as starts from m"""),
    "stream_sliding": (stream_sliding, """with w as (select event_type, epoch(time_bucket(interval 15 minutes, ts))::bigint - 900 * unnest(range(4)) as start_s from events)
        select start_s, event_type, count(*) as n from w group by 1, 2"""),
    "stream_sessions": (stream_sessions, """with g as (select *, case when ts < lag(ts) over w + interval 6 hour then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
        s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as session from g)
        select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts) + interval 6 hour) as end_us, count(*) as n from s group by user_id, session"""),
    "stream_null_times": (stream_null_times, "select case when event_id % 7 <> 0 then epoch(date_trunc('hour', ts))::bigint else -1 end as hour_s, event_type, count(*) as n from events group by 1, 2"),
    "paced_calls": (paced_calls, """with p as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events),
        m as (select *, max(epoch_us(ts) / 1000000 - i * 3600.0::double) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from p)
        select event_id, round(k + i * 3600.0::double, 3) as starts from m"""),
}
