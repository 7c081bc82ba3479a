"""The corpus pipeline: toxicity, n-gram Jaccard join, suffix-array dedup, mixing and packing, each over all that is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswire.llm import jaccard, mixing, packing, suffixes, toxicity
from presswire.llm.common import drop_tables, free_name, keep_last, materialize, numbered, table, written
from presswire.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go; the tagger is fitted on labelled documents of docs that are not held out.

    Null and empty texts score as texts without toxic words. Every row is judged by its own text, so rows that repeat go or stay together.
    Without labels of both classes nothing goes. An empty table gives no rows.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links of Jaccard similarity 0.8 or more connect, one of least doc_id stays.

    Rows are judged one by one: of rows that repeat a doc_id and text one stays, other texts of that doc_id are not touched. Rows
    without doc_id or without words stay. An empty table gives no rows.
    """
    row = free_name(docs)
    rows = numbered(docs, row)
    some = rows.where("doc_id is not null").select(F.col(row).alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    gone = keep_last(spark, lambda: jaccard.join_rows(some).where(~F.col("kept")).select(F.col("row").alias(row)))
    return rows.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document of smaller doc_id has are cut from texts; n_chars follows. No row goes.

    Rows without doc_id, null texts and rows that only repeat what their own doc_id has stay whole. An empty table gives no rows.
    """
    return suffixes.cut_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0, 1 or 2 times. Rows that repeat a doc_id, or have none, are taken or not one by one;
    null texts have no words, so whether they are taken changes no sum. An empty table gives no rows."""
    rows = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    taken = mixing.mix(rows, keep=("_row",)).select("_row", F.explode("copies").alias("copy"))
    return taken.select(*[F.col(f"_row.`{c}`") for c in docs.columns])


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048. A null text is one piece, its end token; rows that repeat are documents of their own."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_documents),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again as the next one's input, then what it read is dropped."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        with written() as paths:
            docs = materialize(stage(spark, docs, sf_dir))
        drop_tables(spark, [*before, *paths[:-1]])
        before = paths[-1:]
    return docs
