"""Spending: daily sums, the check before each spend, and task times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswire.operators import scan
from presswire.operators.ordered import free_name


def counted(cost: Column) -> Column:
    """Costs of 0 or less are not tracked."""
    return F.when(cost > 0, cost).otherwise(0.0)


def daily(spend: DataFrame, ts: str, cost: str) -> DataFrame:
    return spend.groupBy(F.to_date(ts).alias("day")).agg(F.sum(counted(F.col(cost))).alias("amount"), F.count_if(F.col(cost) > 0).alias("n_spends"))


def affordable(spend: DataFrame, keys: list[str], order: list[str], cost: str, limit: Column, free: Column) -> DataFrame:
    """Adds spent_before (of the keys' earlier rows) and allowed: free models always; others only with a limit above 0 not yet reached.

    A key may hold any number of rows: the running sum is a scan over ranges of them.
    """
    out = scan.running(spend, keys, order, counted(F.col(cost)), "sum", "spent_before", own=False)
    out = out.withColumn("spent_before", F.coalesce("spent_before", F.lit(0.0)))
    return out.withColumn("allowed", F.when(limit <= 0, free).otherwise(free | (F.col("spent_before") < limit)))


def task_times(events: DataFrame, key: list[str], ts: str, kind: str, started: str, ended: list[str]) -> DataFrame:
    """Each end with the time since the last start of its key; a start that another end has used up gives null."""
    own = Window.partitionBy(*key).orderBy(ts, "event_id")
    before = F.lag(F.struct(kind, ts)).over(own)
    last = free_name(events, "_last")
    rows = events.where(F.col(kind).isin(started, *ended)).withColumn(last, before).where(F.col(kind).isin(ended))
    seconds = F.when(F.col(last)[kind] == started, F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col(last)[ts].cast("timestamp")))
    return rows.withColumn("micros", seconds).drop(last)
