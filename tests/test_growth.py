"""Work that must grow no faster than the tables: rows shuffled, and parts of an expression that are computed again."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from presswire.functions import reports, text
from presswire.operators import joins, keyword_join, keywords
from presswire.queries import QUERIES
from presswire.sources import sinks


def stages(spark):
    gateway = spark.sparkContext._gateway
    nothing = gateway.jvm.java.util.ArrayList()
    found = spark._jsc.sc().statusStore().stageList(nothing, False, False, gateway.new_array(gateway.jvm.double, 0), nothing)
    return [found.apply(i) for i in range(found.size())]


@contextmanager
def shuffled(spark):
    """A list that holds the records that were written to shuffles inside the block."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    before, out = {s.stageId() for s in stages(spark)}, []
    yield out
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    out.append(sum(s.shuffleWriteRecords() for s in stages(spark) if s.stageId() not in before))


def test_seeds_with_an_item_of_all_their_words_meet_few_items(spark):
    """Every address has a word that half of them have and one of its own."""
    n = 600
    rows = spark.range(n).selectExpr("id", "concat('https://x.com/', 100000 + id, if(id % 2 = 0, '.html', '')) as url", "id % 7 as feed_pos", "id as item_pos", "'common title' as title", "'' as summary")
    items = rows.select("feed_pos", "item_pos", "title", "url", "summary")
    seeds = rows.select(F.col("id").alias("seed_id"), "url", F.lit("common title").alias("title_hint"))
    with shuffled(spark) as records:
        got = sorted((r["seed_id"], r["item_pos"], r["match_confidence"]) for r in joins.similar_seed(seeds, items).collect())
    assert got == [(i, i, 1.0) for i in range(n)]
    assert records[0] < 40 * n  # all pairs that share a word are 360,000


def test_equal_seeds_and_items_are_one(spark):
    """Copies under other keys do not meet each other in pairs; the first item stands for all."""
    n = 400
    items = spark.range(n).selectExpr("id % 3 as feed_pos", "id as item_pos", "concat('t', id) as title", "'https://x.com/news/budget-vote-senate' as url", "'' as summary").withColumn("title", F.lit("budget"))
    seeds = spark.range(n).selectExpr("id as seed_id", "'https://y.com/news/budget-vote-other' as url", "cast(null as string) as title_hint")
    with shuffled(spark) as records:
        got = {tuple(r) for r in joins.similar_seed(seeds, items).select("feed_pos", "item_pos", "title", "match_confidence").collect()}
    assert got == {(0, 0, "budget", 0.75)} and records[0] < 20 * n


@pytest.mark.parametrize("query", ["term_scores", "top_keywords", "word_frequency_top5"])
def test_words_of_a_text_are_not_shuffled(spark, sf_dir, query):
    """At most a row or two for each document, not for each word."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    with shuffled(spark) as records:
        QUERIES[query](spark, sf_dir).collect()
    assert records[0] <= 3 * docs


def test_texts_that_share_a_key_are_one(spark):
    rows = [(1, "The Budget Act passed the senate. Senate votes"), (1, "Budget Act again and again in the senate"), (None, "A text that has no key at all"), (2, "The Budget Act passed the senate. Senate votes"), (3, "The and for with from that"), (4, "short"), (5, None)]
    df = spark.createDataFrame(rows, "doc int, text string")
    got = {(r["doc"], r["term"]): r["tf"] for r in keywords.term_scores(keywords.words(df, "doc", "text"), "doc").collect()}
    assert got == {(1, "budget"): 2, (1, "act"): 2, (1, "passed"): 1, (1, "senate"): 3, (1, "votes"): 1, (1, "again"): 2, (2, "budget"): 1, (2, "act"): 1, (2, "passed"): 1, (2, "senate"): 2, (2, "votes"): 1}


@pytest.mark.parametrize("few", [1000, 0])
def test_texts_that_share_a_key_are_shuffled_once(spark, few):
    """Counts of keys and the texts themselves, each once; texts with keys of their own stay where they are if few keys are shared."""
    n = 600
    docs = spark.range(n).selectExpr("if(id < 400, id div 2, id) as doc", "concat('the Budget Act passed the senate as vote ', id) as text").repartition(4).localCheckpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where Spark takes no side for small
    try:
        with shuffled(spark) as records:
            got = {(r["doc"], r["term"]): r["tf"] for r in keywords.term_scores(keywords.words(docs, "doc", "text", few), "doc").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    terms = ["budget", "act", "passed", "senate", "vote"]
    assert got == {(doc, term): 2 if doc < 200 else 1 for doc in [*range(200), *range(400, n)] for term in terms}
    assert records[0] <= 2 * n


def test_words_of_other_scripts_and_empty_sentences(spark):
    """Numbers of any script are no terms, sentences without words have no number, a capital counts inside a sentence alone."""
    rows = [(1, "... ! The \u0660\u0661\u0662 \u216b\u216b\u216b \u0395\u039b\u039b\u0391\u03a3 rose.\n\n Rose \u00c9tat 123 \u00c9tat."), (2, "?!?! ..... ----- !!!!! ....."), (3, "\u4e00\u4e8c\u4e09 wird 12ab 345 Stra\u00dfe")]
    df = spark.createDataFrame(rows, "doc int, text string")
    got = {(r["doc"], r["term"]): r["tf"] for r in keywords.term_scores(keywords.words(df, "doc", "text"), "doc").collect()}
    assert got == {(1, "\u03b5\u03bb\u03bb\u03b1\u03c2"): 1, (1, "rose"): 2, (1, "\u00e9tat"): 2, (3, "\u4e00\u4e8c\u4e09"): 1, (3, "wird"): 1, (3, "12ab"): 1, (3, "stra\u00dfe"): 1}
    best = {(r["doc"], r["rank"]): r["keyword"] for r in keywords.keywords(df, "doc", "text").collect()}
    assert len({k for d, k in best.items() if d[0] == 1}) == 5 and not any(d == 2 for d, _ in best)


def test_all_keywords_are_gone_through(spark):
    """Near copies fill the places that are looked at first; what follows them is still found."""
    words = " ".join(f"internationalisation{c}{d}" for c in "abcdefgh" for d in "abcdefgh")
    df = spark.createDataFrame([(1, words + ". zebra zebra zebra zebra zebra zebra zebra zebra zebra")], "doc int, text string")
    got = [r["keyword"] for r in keywords.keywords(df, "doc", "text", top_n=20).orderBy("rank").collect()]
    assert "zebra" in got and len(got) < 20


def test_a_report_is_split_into_lines_few_times(spark):
    """Functions of a report use its lines many times; each use must not compute them, and the report, again."""
    df = spark.createDataFrame([("## Source Matrix\n\n| a | b |\n| --- | --- |\n| x | [l](https://a.com/1) |\n\n[^1]: https://b.com/2.", ["https://a.com/1"])], "r string, allowed array<string>")
    out = df.select(reports.report_error(F.col("r"), F.col("allowed")).alias("error"), sinks.matrix_csv(F.col("r")).alias("csv"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") < 10
    assert tuple(out.first()) == ("footnotes outside matrix: https://b.com/2", "a,b\r\nx,[l](https://a.com/1)")


def test_words_by_splitting(spark):
    df = spark.createDataFrame([("The  quick-brown FOX9 jumps é over_it; abc abcd ABCDE",), ("",), (None,), ("....",)], "t string")
    want = [["quick", "brown", "jumps", "over", "abcd", "abcde"], [], None, []]
    assert [r[0] for r in df.select(text.long_words(F.col("t"))).collect()] == want
    assert [r[0] for r in df.select(text.tokens(F.col("t"))).collect()] == [["quick", "brown", "fox9", "jumps", "over", "abc", "abcd", "abcde"], [], None, []]


def test_texts_and_few_keywords_are_not_shuffled(spark):
    """Grams that many words share pair a text with words that it does not hold; short keywords go to the texts."""
    n = 300
    items = spark.range(n).selectExpr("id", "concat('the presentation of station ', id, ' and nation ', id) as text")
    words = spark.range(n).selectExpr("concat('station ', id, ' ') as k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where Spark takes no side for small
    try:
        with shuffled(spark) as records:
            got = sorted((r["id"], r["k"]) for r in keyword_join.contained_keywords(items, "text", words, "k").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [(i, f"station {i} ") for i in range(n)]
    assert records[0] < 20 * n
    assert sorted((r["id"], r["k"]) for r in keyword_join.contained_keywords(items, "text", words, "k", few=0).collect()) == got
