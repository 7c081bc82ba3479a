"""Operators whose meaning depends on arrival order: first wins, caps, running state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def free_name(df: DataFrame, stem: str) -> str:
    """A name that no column of df has, for a column that comes and goes."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order (which should be unique). Spark cuts each partition to one row a key before the shuffle."""
    return cap(df, keys, order, 1)


def cap(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """At most n rows of each key. Apply it before any filter that must not make room for later rows."""
    place = free_name(df, "_n")
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= n).drop(place)


def best(df: DataFrame, keys: list[str], score: str, order: list[str]) -> DataFrame:
    """The row of highest score of each key; the earliest if several have it."""
    return cap(df, keys, [F.desc(score), *order], 1)


def fresh(published: Column, now: Column, hours: int) -> Column:
    """Younger than so many hours; without a date, fresh."""
    return published.isNull() | (published > now - F.make_interval(hours=F.lit(hours)))


def first_success(attempts: DataFrame, key: str, ok: Column, rank: str) -> DataFrame:
    """The first attempt that is ok, else the last one made."""
    return cap(attempts, [key], [F.when(ok, F.col(rank)).asc_nulls_last(), F.desc(rank)], 1)


def balanced_sample(candidates: DataFrame, most: int = 5, least: int = 2, min_text: int = 200) -> DataFrame:
    """Candidates (story_id, pos, domain, bias, text_length) kept by the greedy sampler, with their running number.

    In order of pos: long enough, of a domain not kept before, until `most` are kept, or both sides (bias <= -2 and >= 2) and at least
    `least` are. The stop is monotone, so it is a filter on what precedes each row; an unknown bias is on neither side.
    """
    rows = keep_first(candidates.where(F.col("text_length") >= min_text), ["story_id", "domain"], ["pos"])
    before = Window.partitionBy("story_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    left = F.coalesce(F.max(F.coalesce(F.col("bias") <= -2, F.lit(False))).over(before), F.lit(False))
    right = F.coalesce(F.max(F.coalesce(F.col("bias") >= 2, F.lit(False))).over(before), F.lit(False))
    kept = F.count(F.lit(1)).over(before)
    return rows.withColumns({"_left": left, "_right": right, "kept_before": kept}).where((F.col("kept_before") < most) & ~(F.col("_left") & F.col("_right") & (F.col("kept_before") >= least))).drop("_left", "_right")


def sections(df: DataFrame, keys: list[str], text: str, heading: str) -> DataFrame:
    """One row a line (line_no from 0) with the nearest heading before it (section; null above the first)."""
    lines = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    own = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    title = F.when(F.col("line").rlike(heading), F.trim(F.regexp_replace("line", heading, "")))
    return lines.withColumn("section", F.last(title, ignorenulls=True).over(own))
