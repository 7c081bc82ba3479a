"""Tables that are patched: upserts, backfills, cascades, schema changes. Each returns the new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswire.streaming import folder


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in the folder that driver and executors share, so that what is used several times is computed once and outlives
    an executor. Spark's cleaner removes the files when they are no longer referenced (cleanCheckpoints)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()


def patch(table: DataFrame, changes: DataFrame, key: str, clear: dict[str, str] | None = None) -> DataFrame:
    """Upsert: a change's columns that are not null replace, new keys are added; clear maps a column to the flag that nulls it (a value given wins)."""
    clear = clear or {}
    columns = [c for c in table.columns if c != key]
    joined = table.alias("t").join(changes.alias("c"), key, "full_outer")
    out = [F.col(key)]
    for c in columns:
        if c not in changes.columns:
            out.append(F.col(f"t.{c}").alias(c))
            continue
        value = F.coalesce(F.col(f"c.{c}"), F.col(f"t.{c}"))
        if c in clear:
            value = F.when(F.col(f"c.{c}").isNull() & F.coalesce(F.col(f"c.{clear[c]}"), F.lit(False)), F.lit(None)).otherwise(value)
        out.append(value.alias(c))
    return joined.select(*out)


def backfill(table: DataFrame, names: DataFrame, key: str, templates: list[str], columns: list[str]) -> DataFrame:
    """Rows for names that the table lacks, with the template row's columns (the first of templates that exists, else nulls)."""
    rank = F.array_position(F.array(*map(F.lit, templates)), F.col(key))
    template = table.where(F.col(key).isin(templates)).agg(F.min_by(F.struct(*columns), rank).alias("_t"))  # one row
    missing = names.join(table, key, "left_anti").join(F.broadcast(template), how="left")
    return table.unionByName(missing.select(key, *[F.col(f"_t.{c}").alias(c) for c in columns]), allowMissingColumns=True)


def add_columns(table: DataFrame, defaults: dict) -> DataFrame:
    """Additive migration: columns that are missing get their default."""
    return table.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in table.columns})


def cascade_delete(parents: DataFrame, children: dict[str, DataFrame], gone: DataFrame, key: str, foreign: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parents and children without those in gone (key)."""
    lost = gone.select(F.col(key).alias(foreign))
    return parents.join(gone.select(key), key, "left_anti"), {n: c.join(lost, foreign, "left_anti") for n, c in children.items()}


def violations(table: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once in what should be unique."""
    return table.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(children: DataFrame, parents: DataFrame, foreign: str, key: str) -> DataFrame:
    return children.join(parents.select(F.col(key).alias(foreign)), foreign, "left_anti")
