"""Matching operators: ratings, feeds, seeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswire import dims
from presswire.functions import rating, text, urls
from presswire.operators.ordered import free_name
from presswire.operators.store import cut


def rate_domains(df: DataFrame, domain: str) -> DataFrame:
    """Adds bias, bias_label, confidence, method, factual, category of the domain from the rated list; unknown ones get 0, 0.0 and 'unknown'.

    Columns of df that have these names are replaced, but for the one that holds the domain.
    """
    rated = dims.rated_domains(df.sparkSession).select("domain", "bias", "factual", "category")
    entry = free_name(df, "_rated")
    known = rated.select(F.struct(*rated.columns).alias(entry))
    out = df.join(F.broadcast(known), urls.dataset_key(F.col(domain)) == F.col(f"{entry}.domain"), "left")
    hit = F.col(entry).isNotNull()
    rating_columns = {
        "bias_label": F.when(hit, rating.label(F.col(f"{entry}.bias"))).otherwise("Unknown"),
        "confidence": F.when(hit, 1.0).otherwise(0.0),
        "method": F.when(hit, "dataset").otherwise("unknown"),
        "bias": F.coalesce(f"{entry}.bias", F.lit(0)),
        "factual": F.col(f"{entry}.factual"),
        "category": F.col(f"{entry}.category"),
    }
    return out.withColumns({k: v for k, v in rating_columns.items() if k != domain}).drop(entry)


def candidate_feeds(domains: DataFrame, feeds: DataFrame) -> DataFrame:
    """domain, feed_pos: feeds that belong to a domain by host or hint; all feeds for a domain that none belongs to.

    A theta join with the feed list, which is of fixed size.
    """
    hints = domains.sparkSession.createDataFrame(dims.DOMAIN_HINTS, "hint_domain string, hints array<string>")
    host = F.lower(urls.domain(F.col("url")))
    listed = feeds.select("feed_pos", host.alias("feed_host"), F.lower(F.concat_ws(" ", "name", "url")).alias("words"))
    pairs = domains.join(F.broadcast(hints), F.col("domain") == F.col("hint_domain"), "left").join(F.broadcast(listed))
    hinted = F.exists(F.coalesce("hints", F.array().cast("array<string>")), lambda h: F.col("words").contains(h))
    hit = F.col("feed_host").contains(F.col("domain")) | F.col("domain").contains(F.col("feed_host")) | hinted
    flagged = pairs.withColumn("hit", hit)
    some = flagged.groupBy("domain").agg(F.max("hit").alias("some"))
    return flagged.join(some, "domain").where("hit or not some").select("domain", "feed_pos")


def exact_seed(seeds: DataFrame, items: DataFrame) -> DataFrame:
    """seeds (seed_id, url) joined with the first item (feed_pos, item_pos, url, title) of the same URL key."""
    key = items.select(urls.normalize(F.col("url")).alias("key"), "feed_pos", "item_pos", "title")
    first = key.groupBy("key").agg(F.min_by(F.struct("feed_pos", "item_pos", "title"), F.struct("feed_pos", "item_pos")).alias("m"))
    out = seeds.select("seed_id", urls.normalize(F.col("url")).alias("key")).join(first, "key")
    return out.select("seed_id", "m.feed_pos", "m.item_pos", "m.title", F.lit("exact_url").alias("match_type"), F.lit(1.0).alias("match_confidence"))


LEVELS = (1.0, 0.9, 0.75, 0.6)  # shares that are looked for first
FEW = 200_000  # rows of two numbers that are sent to every task


def similar_seed(seeds: DataFrame, items: DataFrame, least: float = 0.45, title_weight: float = 0.9) -> DataFrame:
    """seeds (seed_id, url, title_hint) with the item that holds most of their slug's (or, at title_weight, their title's) tokens.

    An item that holds a share of a seed's n slug tokens, `level`, holds one of any n - ceil(level * n) + 1 of them; likewise of the title's, at
    level / title_weight. The join is on that many of each seed's rarest tokens alone: tokens that stand in very many items, such as
    the parts that all URLs have, pair nothing. It is made for high levels first, where that is one token or two: a seed that has an item of this
    level has its best among the pairs, and only the others go on to lower levels, down to `least`. Pairs are scored on all tokens.

    Seeds of equal tokens are one, and so are items, of which the first stands for all. Postings are hashes, so a pair may be of other
    tokens; scores tell. Both sides are checkpointed: they are read several times, and what they are made of may be dear.
    """
    none = F.array().cast("array<string>")
    own = seeds.where(F.col("seed_id").isNotNull())
    own = cut(own.select("seed_id", F.array_sort(F.coalesce(text.tokens(urls.path(F.col("url"))), none)).alias("slug"), F.array_sort(text.tokens(F.coalesce("title_hint", F.lit("")))).alias("hint")))
    rest = cut(own.select("slug", "hint").distinct().withColumn("set_no", F.monotonically_increasing_id()))
    tokens = F.array_sort(text.tokens(F.concat_ws(" ", "title", "summary", "url")))
    right = items.where(F.col("feed_pos").isNotNull() & F.col("item_pos").isNotNull()).groupBy(tokens.alias("tokens")).agg(F.min(F.struct("feed_pos", "item_pos", "title")).alias("first"))
    right = cut(right.withColumn("item_no", F.monotonically_increasing_id()))
    postings = right.select("item_no", F.explode(F.transform("tokens", lambda t: F.xxhash64(t))).alias("token"))
    often = cut(postings.groupBy("token").agg(F.count(F.lit(1)).alias("n_items")))
    share = lambda side: F.size(F.array_intersect(side, "tokens")) / F.greatest(F.size(side), F.lit(1))

    def at_least(rest: DataFrame, level: float) -> DataFrame:
        """set_no, b: the best item of the seeds that have one of this level."""
        pairs = rare(rest, "slug", level)
        if level <= title_weight:
            pairs = pairs.unionByName(rare(rest, "hint", level / title_weight))
        pairs = cut(pairs.distinct())
        pairs = postings.join(F.broadcast(pairs) if pairs.count() <= FEW else pairs, "token").select("set_no", "item_no").distinct()
        scored = pairs.join(rest, "set_no").join(right, "item_no").select("set_no", "first", F.greatest(share("slug"), title_weight * share("hint")).alias("match_confidence"))
        return scored.where(F.col("match_confidence") >= level).groupBy("set_no").agg(F.min(F.struct((-F.col("match_confidence")).alias("minus"), "first")).alias("b"))

    def rare(rest: DataFrame, side: str, level: float) -> DataFrame:
        """The tokens of a side that pair: of a token in no item the pair is empty, but it counts among the rarest."""
        each = rest.select("set_no", F.size(side).alias("n"), F.explode(F.transform(side, lambda t: F.xxhash64(t))).alias("token")).join(often, "token", "left")
        place = F.row_number().over(Window.partitionBy("set_no").orderBy(F.coalesce("n_items", F.lit(0)), "token"))
        return each.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * level - 1e-9) + 1).where("n_items > 0").select("set_no", "token")

    found = []
    for level in [x for x in LEVELS if x > least] + [least]:
        best = cut(at_least(rest, level))
        found.append(rest.join(best, "set_no").select("slug", "hint", "b"))
        rest = cut(rest.join(best, "set_no", "left_anti"))
        if rest.isEmpty():
            break
    found = own.join(reduce(DataFrame.unionByName, found), ["slug", "hint"]).groupBy("seed_id").agg(F.min("b").alias("b")).select("seed_id", "b.first.*", -F.col("b.minus"))
    return found.toDF("seed_id", "feed_pos", "item_pos", "title", "match_confidence").select("seed_id", "feed_pos", "item_pos", "title", F.lit("slug_title").alias("match_type"), "match_confidence")


def contains_any(words: Column, keys: Column) -> Column:
    """Any of the keys occurs in the words; an empty key occurs in everything."""
    return F.exists(keys, lambda k: words.contains(F.lower(k)))


def resolve_bias(df: DataFrame, dataset: str, site: str, model: str, heuristic: Column) -> DataFrame:
    """The priority chain over columns: dataset rating (1.0), site rating (0.6), model's struct(bias, confidence), heuristic (0.2)."""
    return df.withColumns(
        {
            "method": F.when(F.col(dataset).isNotNull(), "dataset").when(F.col(site).isNotNull(), "allsides").when(F.col(model).isNotNull(), "llm").otherwise("heuristic"),
            "bias": F.coalesce(F.col(dataset), F.col(site), F.col(f"{model}.bias"), heuristic),
            "confidence": F.when(F.col(dataset).isNotNull(), 1.0).when(F.col(site).isNotNull(), 0.6).otherwise(F.coalesce(F.col(f"{model}.confidence"), F.lit(0.2))),
        }
    )
