import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names operators use themselves."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "same text that is copied " * 5, "en", "a", 1), (4, "same text that is copied " * 5, None, None, None),
        (5, long, "en", "b", 2), (5, long, "en", "b", 2), (6, "short", "en", "b", 5), (None, "no id here", "en", "c", 3), (7, "ünïcödé \U0001f600 " * 30, "de", "c", 4), (8, " \n\t ", "fr", "d", 3),
        (9, "idiot <|endoftext|> and moron", "en", "d", 9),
    ]
    df = spark.createDataFrame(rows, DOCS)
    clash = ["id", "size", "block", "task", "_task", "score", "spans", "kept", "uid", "length", "piece", "component", "node", "target", "copies", "shard", "unit", "_data", "data", "label", "toxic", "fill", "bucket"]
    for i, c in enumerate(clash):
        df = df.withColumn(c, F.lit(f"x{i}") if i % 2 else F.lit(i))
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
