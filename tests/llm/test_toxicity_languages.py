"""Held-out toxic documents are found in every language, the rare ones too, and clean ones left alone."""

from pyspark.sql import functions as F

from presswire.llm import toxicity
from presswire.llm.common import table

SF = "/root/testdata/sf0.1"


def test_recall_by_language(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).where(toxicity.is_held_out())
    rows = scored.join(docs.select("doc_id", "lang"), "doc_id").join(labels, "doc_id")
    hit = F.col("score") >= 0.3
    got = {r["lang"]: r for r in rows.groupBy("lang").agg(F.sum("toxic").alias("n"), F.count_if(hit & (F.col("toxic") == 1)).alias("found"), F.count_if(hit & (F.col("toxic") == 0)).alias("wrong"), F.count_if(F.col("toxic") == 0).alias("clean")).collect()}
    assert set(got) == {"de", "en", "es", "fr"}
    for lang, r in got.items():
        assert r["n"] > 5 and r["found"] >= 0.8 * r["n"] and r["wrong"] <= 0.03 * r["clean"], (lang, r)
    assert sum(r["found"] for r in got.values()) >= 0.9 * sum(r["n"] for r in got.values())
