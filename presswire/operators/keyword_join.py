"""Texts joined with a table of keywords that they contain: an inverted index of character n-grams, on which each keyword uses its rarest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswire.operators.ordered import free_name
from presswire.operators.store import cut

GRAM = 5  # long enough that most of what meets is contained
FEW = 200_000  # keywords that are sent to every task
HOT = 1_000_000  # postings of a gram from which on it is dealt to several tasks


def grams(text: Column, n: int) -> Column:
    """All runs of n characters; one pass, since a pattern that looks ahead moves on by one character."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def contained_keywords(items: DataFrame, text: str, keywords: DataFrame, keyword: str, hot: int = HOT, few: int = FEW) -> DataFrame:
    """items, once for each distinct keyword (lower case) that their text contains in any case: all their columns, and `keyword`.

    Neither side is bounded, so no list of keywords is sent around unless it is counted and short. A text that contains a keyword contains all
    its grams of GRAM characters (a shorter keyword is a gram by itself), so each keyword meets only the texts that have the one of its
    grams that is rarest over all texts; what meets is then verified. A keyword with a gram that no text has meets none. Up to FEW
    keywords go to every task, and no text is shuffled; of more, both sides are shuffled by gram, and grams of more than `hot`
    postings (and a thousandth of all, so at most 1,000 grams) are dealt to so many tasks that each gets about `hot`. Texts are read
    twice, for the counts and for the join.

    Null texts contain nothing, the empty keyword is in every text that is not null, null keywords are none; repeated keywords count once, repeated
    items are items of their own. A column of items with the keyword's name is replaced.
    """
    items = items.drop(keyword)
    words = keywords.select(F.lower(F.col(keyword)).alias(keyword)).where(F.col(keyword).isNotNull()).distinct()
    words = cut(words)
    sizes = sorted(r[0] for r in words.select(F.least(F.length(keyword), F.lit(GRAM))).distinct().collect())  # six numbers at most
    low, gram, salt, salts = F.lower(F.col(text)), free_name(items, "_gram"), free_name(items, "_salt"), free_name(items, "_salts")
    out = items.where(F.col(text).isNotNull()).withColumn(keyword, F.lit("")) if 0 in sizes else items.limit(0).withColumn(keyword, F.lit(""))
    if not any(sizes):
        return out
    own = words.where(F.length(keyword) > 0).select(keyword, F.explode(F.when(F.length(keyword) < GRAM, F.array(keyword)).otherwise(grams(F.col(keyword), GRAM))).alias(gram))
    postings = F.explode(F.array_distinct(F.concat(*[grams(low, n) for n in sizes if n]))).alias(gram)
    asked = cut(own.select(gram).distinct())
    asked = F.broadcast(asked) if asked.count() <= few else asked
    found = cut(items.select(postings).join(asked, gram, "left_semi").groupBy(gram).agg(F.count(F.lit(1)).alias("n")))
    n = F.coalesce("n", F.lit(0))
    chosen = own.join(found, gram, "left").groupBy(keyword).agg(F.min(n).alias("least"), F.min_by(gram, F.struct(n, F.col(gram))).alias(gram)).where("least > 0").drop("least")
    chosen = cut(chosen)
    if chosen.count() <= few:
        return out.unionByName(items.select("*", postings).join(F.broadcast(chosen), gram).where(low.contains(F.col(keyword))).drop(gram))
    total = found.agg(F.sum("n")).first()[0] or 0
    limit = max(hot, total // 1000)
    split = F.broadcast(found.where(F.col("n") > limit).select(gram, F.ceil(F.col("n") / limit).cast("int").alias(salts)))
    sides = chosen.join(split, gram, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1))).drop(salts)
    rows = items.select("*", postings).join(chosen.select(gram).distinct(), gram, "left_semi").join(split, gram, "left")
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in items.columns]), F.coalesce(salts, F.lit(1))).cast("int")).drop(salts)
    pairs = rows.join(sides, [gram, salt]).where(low.contains(F.col(keyword))).drop(gram, salt)
    return out.unionByName(pairs)
