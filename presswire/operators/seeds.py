"""Seed recovery: a seed's item among the feeds that belong to its domain, by address, else by the words of its slug or title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswire import dims
from presswire.functions import text, urls
from presswire.operators import joins, keyword_join
from presswire.operators.ordered import cap
from presswire.operators.store import cut

LISTED = 1000  # feeds up to which every domain is compared with the list of them


def feeds_of_domains(domains: DataFrame, feeds: DataFrame) -> DataFrame:
    """domain, feed_pos: feeds (feed_pos, name, url) whose host holds the domain or is held by it, or whose name or address has one of its hints.

    Domains without such feeds give no rows, and neither do empty ones. A feed list is short, and is then compared as a whole; one of more than LISTED
    feeds is joined by the n-grams that hosts and domains share.
    """
    hints = domains.sparkSession.createDataFrame([(d, h) for d, hs in dims.DOMAIN_HINTS for h in hs], "domain string, hint string")
    listed = cut(feeds.select("feed_pos", F.lower(urls.domain(F.col("url"))).alias("host"), F.lower(F.concat_ws(" ", "name", "url")).alias("words")))
    some = cut(domains.where("domain <> ''").select("domain").distinct())
    if listed.count() <= LISTED:
        pairs = some.join(F.broadcast(listed), F.col("host").contains(F.col("domain")) | F.col("domain").contains(F.col("host"))).select("domain", "feed_pos")
    else:
        holds = keyword_join.contained_keywords(listed.select("feed_pos", "host"), "host", some, "domain").select("domain", "feed_pos")
        held = keyword_join.contained_keywords(some, "domain", listed.select("host"), "host").join(listed.select("feed_pos", "host"), "host").select("domain", "feed_pos")
        pairs = holds.unionByName(held)
    # Hints are a fixed list; only the feeds' side can be long.
    hinted = some.join(F.broadcast(hints), "domain").join(listed, F.col("words").contains(F.col("hint"))).select("domain", "feed_pos")
    return cut(pairs.unionByName(hinted).distinct())


def scored(pairs: DataFrame, least: float, title_weight: float) -> DataFrame:
    """For each seed the item of its pairs with the same address that comes first, else the one with the highest share of its words."""
    share = lambda side: F.size(F.array_intersect(side, "tokens")) / F.greatest(F.size(side), F.lit(1))
    score = F.greatest(share("slug"), title_weight * share("hint"))
    rows = pairs.withColumn("score", F.when(F.col("key") == F.col("item_key"), 2.0).otherwise(score)).where((F.col("score") > 1.5) | (F.size("tokens") > 0) & (F.col("score") >= least))
    order = F.struct(-F.col("score"), "feed_pos", "item_pos")
    best = rows.groupBy("seed_id").agg(F.min_by(F.struct("feed_pos", "item_pos", "title", "score"), order).alias("b")).select("seed_id", "b.*")
    exact = F.col("score") > 1.5
    return best.select("seed_id", "feed_pos", "item_pos", "title", F.when(exact, "exact_url").otherwise("slug_title").alias("match_type"), F.when(exact, 1.0).otherwise(F.col("score")).alias("match_confidence"))


def seed_words(url: Column) -> Column:
    return text.tokens(urls.path(url))


def recover(seeds: DataFrame, feeds: DataFrame, items: DataFrame, per_feed: int = 80, least: float = 0.45, title_weight: float = 0.9) -> DataFrame:
    """seed_id, feed_pos, item_pos, title, match_type, match_confidence of the seeds (seed_id, url, title_hint) that an item is found for.

    Only the first per_feed items of a feed are looked at, and of feeds only those that belong to the seed's domain; all feeds if none does. An
    item with the seed's address (key) comes first, in order of feeds and items; for seeds without one the item that holds the largest share of the
    slug's or, at title_weight, the title's words, from `least` on.

    Seeds of known domains meet their feeds' items, so at most per_feed for each of these feeds. The others would meet every item; they are
    joined by address, and the rest by their rarest words (joins.similar_seed). Items and seeds are parsed once.
    """
    url = F.coalesce("url", F.lit(""))
    first = cap(items, ["feed_pos"], ["item_pos"], per_feed)
    kept = cut(first.select("feed_pos", "item_pos", "title", F.col("url").alias("item_url"), "summary", urls.normalize(F.col("url")).alias("item_key"), text.tokens(F.concat_ws(" ", "title", "summary", "url")).alias("tokens")))
    own = cut(seeds.select("seed_id", url.alias("url"), "title_hint", F.lower(urls.domain(url)).alias("domain"), urls.normalize(url).alias("key"), seed_words(url).alias("slug"), text.tokens(F.coalesce("title_hint", F.lit(""))).alias("hint")))
    near = feeds_of_domains(own.select("domain"), feeds)
    found = scored(own.join(near, "domain").join(kept.drop("item_url", "summary"), "feed_pos"), least, title_weight)
    rest = own.join(near, "domain", "left_anti")
    address = rest.select("seed_id", "key").join(kept.select(F.col("item_key").alias("key"), "feed_pos", "item_pos", "title"), "key")
    address = address.groupBy("seed_id").agg(F.min(F.struct("feed_pos", "item_pos", "title")).alias("m")).select("seed_id", "m.*", F.lit("exact_url").alias("match_type"), F.lit(1.0).alias("match_confidence"))
    address = cut(address)
    words = joins.similar_seed(rest.join(address, "seed_id", "left_anti").select("seed_id", "url", "title_hint"), kept.select("feed_pos", "item_pos", "title", F.col("item_url").alias("url"), "summary"), least, title_weight)
    return found.unionByName(address).unionByName(words)
