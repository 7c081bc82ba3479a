"""Feed documents and search replies to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswire.functions import text, urls
from presswire.operators.ordered import cap, fresh

# Time ranges of search replies; week where none fits.
TIME_RANGES = {"d": "day", "w": "week", "m": "month"}
SEARCH_REPLY = "results array<struct<title:string,url:string,content:string,snippet:string,engine:string,source:string,publishedDate:string>>"
DATE_FORMATS = [
    "d MMM yyyy HH:mm[:ss] Z", "d MMM yyyy HH:mm[:ss] z", "d MMM yy HH:mm[:ss] Z", "d MMM yy HH:mm[:ss] z", "yyyy-MM-dd'T'HH:mm[:ss][.SSSSSSSSS]XXX", "yyyy-MM-dd'T'HH:mm[:ss][.SSSSSSSSS]XX", "yyyy-MM-dd'T'HH:mm[:ss][.SSSSSSSSS]",
    "yyyy-MM-dd HH:mm[:ss][.SSSSSSSSS]", "yyyy-MM-dd", "d MMM yyyy",
]


def timestamp(value: Column) -> Column:
    """The first format that reads the text (a weekday before it is left out; no zone counts as the session's); null if none does."""
    value = F.nullif(F.regexp_replace(F.trim(value), r"^[A-Za-z]{3,9},?\s+", ""), F.lit(""))
    return F.coalesce(*[F.try_to_timestamp(F.when(F.length(value) > 9, value), F.lit(f)) for f in DATE_FORMATS])


def items(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """RSS and Atom documents (feed_pos, xml, name, bias) to items in order: item_pos, title, url, domain, published, summary (500 characters), bias, source_name.

    Documents are cut into items by regular expression, so one that is not well-formed still gives those before the fault. Entities are
    decoded but in CDATA; a date comes from pubDate, published, dc:date or updated.
    """
    entry = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), F.lit(1))
    rows = documents.select("feed_pos", "name", "bias", F.posexplode(entry).alias("item_pos", "item"))

    def inner(name: str) -> Column:
        return F.regexp_extract("item", rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1)

    def href(kind: str) -> Column:
        return F.regexp_extract("item", rf'(?is)<link\b{kind}[^>]*href="([^"]*)"', 1)

    # All fields of an item are decoded as one array, so that the plan holds the decoding once.
    names = ["title", "link", "summary", "description", "pubDate", "published", "dc:date", "updated"]
    raw = F.array(*[inner(n) for n in names], href(r'(?=[^>]*rel="alternate")'), href(""))
    whole = lambda x: F.regexp_extract(x, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", 1)
    fields = F.transform(raw, lambda x: F.nullif(F.trim(F.when(whole(x) != "", whole(x)).otherwise(text.unescape(x))), F.lit("")))
    rows = rows.withColumn("f", fields)
    field = {n: F.col("f")[i] for i, n in enumerate([*names, "alternate", "href"])}
    rows = rows.select("feed_pos", "item_pos", "bias", "name", F.coalesce(field["title"], F.lit("")).alias("title"), F.coalesce(field["link"], field["alternate"], field["href"], F.lit("")).alias("url"), *[field[n].alias(n) for n in names[2:]])
    return rows.select(
        "feed_pos",
        "item_pos",
        "title",
        "url",
        urls.domain(F.col("url")).alias("domain"),
        F.coalesce(*[timestamp(F.col(f"`{n}`")) for n in names[4:]]).alias("published"),
        F.substring(F.coalesce("summary", "description", F.lit("")), 1, 500).alias("summary"),
        "bias",
        F.col("name").alias("source_name"),
    )


def scan(all_items: DataFrame, feeds: DataFrame, now: Column, hours: int = 24, per_feed: int = 5, categories: list[str] | None = None) -> DataFrame:
    """Union of feeds: only chosen categories, the first per_feed items of each, then those that are fresh. The cap comes first."""
    chosen = feeds if categories is None else feeds.where(F.col("category").isin(categories))
    rows = all_items.join(F.broadcast(chosen.select("feed_pos", "category")), "feed_pos")
    return cap(rows, ["feed_pos"], ["item_pos"], per_feed).where(fresh(F.col("published"), now, hours))


def search_results(replies: DataFrame, json: str = "json", most: int = 10) -> DataFrame:
    """JSON search replies (query_pos, json) to title, url, snippet, source; at most `most` of each. A reply that is no JSON gives none."""
    found = F.slice(F.from_json(F.col(json), SEARCH_REPLY)["results"], 1, most)
    rows = replies.select("query_pos", F.posexplode(found).alias("result_pos", "r"))
    return rows.select(
        "query_pos",
        "result_pos",
        F.coalesce("r.title", F.lit("")).alias("title"),
        F.coalesce("r.url", F.lit("")).alias("url"),
        F.coalesce(text.first_of(F.col("r.content"), F.col("r.snippet")), F.lit("")).alias("snippet"),
        F.coalesce(text.first_of(F.col("r.engine"), F.col("r.source")), urls.netloc(F.col("r.url"))).alias("source"),
    )


def time_range(code: Column) -> Column:
    out = F.lit("week")
    for short, long in TIME_RANGES.items():
        out = F.when(code == short, long).otherwise(out)
    return out


def user_agents(setting: Column, most: Column) -> Column:
    """User agents of a setting split at ||, blanks dropped, at most so many."""
    every = F.filter(F.transform(F.split(setting, r"\|\|"), lambda x: F.trim(x)), lambda x: x != "")
    return F.slice(every, F.lit(1), F.greatest(most, F.lit(1)))
