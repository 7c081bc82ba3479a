"""Discovery: feed items by topic first, search results where feeds give too little."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswire.functions import urls
from presswire.operators.joins import contains_any
from presswire.operators.ordered import cap, free_name, fresh, keep_first


def feed_records(items: DataFrame, topics: list[str], now: Column, hours: int = 48, per_feed: int = 10) -> DataFrame:
    """Items (feed_pos, item_pos, title, summary, url, published) that name a topic: capped per feed, fresh, matched, first of each URL; rank from 1."""
    rows = cap(items, ["feed_pos"], ["item_pos"], per_feed).where(fresh(F.col("published"), now, hours))
    rows = rows.where(contains_any(F.lower(F.concat_ws(" ", "title", "summary")), F.array(*map(F.lit, topics[:8]))))
    rows = keep_first(rows.withColumn("key", urls.normalize_or_empty(F.col("url"))).where("key <> ''"), ["key"], ["feed_pos", "item_pos"])
    return rows


def prefetch(items: DataFrame, results: DataFrame, topics: list[str], now: Column, target: int = 10) -> DataFrame:
    """key, origin ('rss' or 'search'), at most max(1, target) of them: search results (query_pos, result_pos, url) only if feeds gave less than 0.6 of that.

    Both sides are cut to target rows in order before they meet, so the union is of bounded size.
    """
    target = max(1, target)
    few = max(1, int(target * 0.6))
    rss = feed_records(items, topics, now).orderBy("feed_pos", "item_pos").limit(target).select("key", F.lit(0).alias("o"), F.col("feed_pos").alias("a"), F.col("item_pos").alias("b"))
    found = results.where(F.col("url").startswith("http")).withColumn("key", urls.normalize_or_empty(F.col("url"))).where("key <> ''")
    found = keep_first(found, ["key"], ["query_pos", "result_pos"]).join(F.broadcast(rss.select("key")), "key", "left_anti")
    extra = found.orderBy("query_pos", "result_pos").limit(target).select("key", F.lit(1).alias("o"), F.col("query_pos").alias("a"), F.col("result_pos").alias("b"))
    have = rss.agg(F.count(F.lit(1)).alias("have"))
    extra = extra.crossJoin(F.broadcast(have)).where(F.col("have") < few).drop("have")  # one row on that side
    both = rss.unionByName(extra)
    rank = F.row_number().over(Window.orderBy("o", "a", "b"))  # 2 * target rows at most
    return both.withColumn("rank", rank).where(F.col("rank") <= target).select("rank", "key", F.when(F.col("o") == 0, "rss").otherwise("search").alias("origin"))


def news_then_web(results: DataFrame, least: int = 4) -> DataFrame:
    """Results (query_pos, kind, result_pos, ...) with web ones only for queries that have fewer than `least` news ones."""
    news = F.count_if(F.col("kind") == "news").over(Window.partitionBy("query_pos"))
    n = free_name(results, "_n")
    return results.withColumn(n, news).where((F.col("kind") == "news") | (F.col(n) < least)).drop(n)


def aggregator_queries(story: Column, title: Column, rss_title: Column, summary_terms: Column, slug_terms: Column) -> Column:
    """Up to four search queries of a story, in order, without repeats in other case."""
    text = F.trim(story)
    has, named, rss = text != "", F.coalesce(F.trim(title), F.lit("")) != "", F.coalesce(rss_title, F.lit("")) != ""
    quoted = lambda t: F.concat(F.lit('"'), t, F.lit('"'))
    made = F.array(
        F.when(has, text),
        F.when(named, quoted(F.trim(title))),
        F.when(named & has, F.concat_ws(" ", F.trim(title), text)),
        F.when(rss, quoted(rss_title)),
        F.when(rss & has, F.concat_ws(" ", rss_title, text)),
        F.nullif(summary_terms, F.lit("")),
        F.nullif(slug_terms, F.lit("")),
    )
    return F.slice(distinct_ignoring_case(F.array_compact(made)), 1, 4)


def discovery_queries(topics: Column) -> Column:
    """Up to six: the first three topics joined, then the first five; a default without topics."""
    kept = F.filter(F.transform(topics, lambda t: F.trim(t)), lambda t: t != "")
    made = F.concat(F.array(F.array_join(F.slice(kept, 1, 3), " ")), F.slice(kept, 1, 5))
    return F.when(F.size(kept) == 0, F.array(F.lit("breaking news politics"))).otherwise(F.slice(distinct_ignoring_case(made), 1, 6))


def distinct_ignoring_case(values: Column) -> Column:
    """The first spelling of each, in order."""
    low = F.transform(values, lambda v: F.lower(v))
    return F.filter(F.zip_with(values, F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1))), lambda v, i: F.when(F.array_position(low, F.lower(v)) == i, v)), lambda v: v.isNotNull())
