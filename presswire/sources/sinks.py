"""Sinks: tables, report text, matrix export, prompt text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswire.functions import reports
from presswire.functions.text import once


def stories(df: DataFrame) -> DataFrame:
    """New story rows (title, description, keywords): id from the natural key, so that a rerun writes the same row."""
    return df.select(
        F.sha2(F.concat_ws("\n", "title", "description"), 256).alias("id"), F.substring("title", 1, 500).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"), F.to_json("keywords").alias("keywords"), F.lit("pending").alias("status"),
    )


def sources(df: DataFrame) -> DataFrame:
    """New source rows (story_id, domain, url, title, full_text, author, published_date, political_bias, bias_confidence) with their defaults."""
    return df.select(
        F.sha2(F.concat_ws("\n", "story_id", "url"), 256).alias("id"), "story_id", "domain", "url", F.substring("title", 1, 500).alias("title"), F.coalesce("full_text", F.lit("")).alias("full_text"), "author", "published_date",
        F.coalesce("political_bias", F.lit(0)).alias("political_bias"), F.coalesce("bias_confidence", F.lit(0.0)).alias("bias_confidence"),
    )


def json_text(text: Column) -> Column:
    """A text as a JSON string."""
    coded = F.to_json(F.array(text))
    return F.substring(coded, F.lit(2), F.length(coded) - 2)


def json_back(text: Column) -> Column:
    """What json_text() encoded."""
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")[0]


def analyses(df: DataFrame, facts: tuple[str, ...] = ("agreed_facts", "left_only_facts", "right_only_facts")) -> DataFrame:
    """New analysis rows: story_id, the lists of facts as JSON, full_report_json. The report comes as JSON already and is encoded once more, as
    stored rows have it: read it with json_back() before from_json()."""
    return df.select(F.sha2("story_id", 256).alias("id"), "story_id", *[F.to_json(F.coalesce(c, F.array().cast("array<string>"))).alias(c) for c in facts], json_text(F.col("full_report_json")).alias("full_report_json"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def report_files(df: DataFrame, path: str, report: str = "full_report_md") -> None:
    """One line of text a row of report lines; partitioned by story."""
    df.select("story_id", F.explode(F.split(report, "\n")).alias("value")).write.mode("overwrite").partitionBy("story_id").text(path)


def matrix_csv(report: Column) -> Column:
    """The source matrix as CSV text with CRLF; null without a table."""
    return once(reports.matrix_table(report), lambda table: F.when(table.isNotNull(), F.array_join(F.transform(table, reports.csv_line), "\r\n")))


def matrix_files(df: DataFrame, path: str, report: str = "full_report_md") -> None:
    df.select(matrix_csv(F.col(report)).alias("value")).where("value is not null").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def prompt_blocks(df: DataFrame, key: str, order: str, head: Column, excerpt: Column) -> DataFrame:
    """key, prompt: numbered blocks of head and excerpt (2000 characters) in order."""
    block = F.struct(F.col(order).alias("o"), F.concat(head, F.lit("\n"), F.substring(excerpt, 1, 2000)).alias("b"))
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    numbered = F.transform("blocks", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["b"]))
    return rows.select(key, F.array_join(numbered, "\n\n").alias("prompt"))
