"""Feed documents through Spark's XML reader: items as rows however long a document is, what is not well-formed routed to the pattern reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswire.functions import urls
from presswire.operators.store import cut
from presswire.sources import feeds

BROKEN = "_broken"
LINK = "array<struct<_VALUE:string,_href:string,_rel:string>>"
# One schema for RSS items and Atom entries; namespaces are left out, so dc:date is date.
ITEM = f"title string, link {LINK}, summary string, description string, pubDate string, published string, date string, updated string, {BROKEN} string"
DATES = ["pubDate", "published", "date", "updated"]


def rows(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """The elements of one tag in the files of a path, one a row: ITEM's fields, file, at (a number that grows along a file).

    Files are split like any others and need not fit in a task; documents may be many to a file. An element that is no XML is a row of
    nulls with its text in BROKEN.
    """
    # This parser cuts files into elements before it parses them; the other reads a file as one document and ends where that is no XML.
    reader = spark.read.schema(ITEM).option("rowTag", tag).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).option("ignoreNamespace", "true").option("useLegacyXMLParser", "true").option("valueTag", "_VALUE")
    return reader.format("xml").load(path).withColumns({"file": F.col("_metadata.file_path"), "at": F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))})


def fields(found: DataFrame) -> DataFrame:
    """title, url, domain, published, summary (500 characters), as feeds.items() has them, of rows() that are XML."""
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    links = F.transform("link", lambda x: F.struct(clean(x["_VALUE"]).alias("text"), clean(x["_href"]).alias("href"), F.coalesce(x["_rel"], F.lit("alternate")).alias("rel")))
    first = lambda keep, value: F.get(F.transform(F.filter(links, keep), value), F.lit(0))
    url = F.coalesce(
        first(lambda x: x["text"].isNotNull(), lambda x: x["text"]), first(lambda x: x["href"].isNotNull() & (x["rel"] == "alternate"), lambda x: x["href"]), first(lambda x: x["href"].isNotNull(), lambda x: x["href"]), F.lit("")
    )
    return found.select(
        "file",
        "at",
        F.coalesce(clean(F.col("title")), F.lit("")).alias("title"),
        url.alias("url"),
        urls.domain(url).alias("domain"),
        F.coalesce(*[feeds.timestamp(F.col(n)) for n in DATES]).alias("published"),
        F.substring(F.coalesce(clean(F.col("summary")), clean(F.col("description")), F.lit("")), 1, 500).alias("summary"),
    )


def items(spark: SparkSession, path: str) -> DataFrame:
    """file, item_pos, title, url, domain, published, summary, parsed of the RSS items and Atom entries in the files of a path.

    Items that are no XML are read by pattern (parsed is false), so one bad item costs nothing but itself. item_pos counts a file's items
    of one kind in their order.
    """
    found = cut(rows(spark, path, "item").unionByName(rows(spark, path, "entry")))  # parsed once; Spark asks for it before broken rows are looked at
    good = fields(found.where(F.col(BROKEN).isNull())).withColumn("parsed", F.lit(True))
    bad = found.where(F.col(BROKEN).isNotNull()).select("file", "at", F.lit(0).alias("feed_pos"), F.col(BROKEN).alias("xml"), F.lit("").alias("name"), F.lit(0).alias("bias"))
    # The pattern reader numbers the items of a document by place; a broken element is a document of one.
    read = feeds.items(bad.withColumn("feed_pos", F.struct("file", "at"))).where("item_pos = 0")
    read = read.select(F.col("feed_pos.file").alias("file"), F.col("feed_pos.at").alias("at"), "title", "url", "domain", "published", "summary", F.lit(False).alias("parsed"))
    out = good.unionByName(read)
    return out.withColumn("item_pos", F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1).drop("at")


def escaped(value: Column) -> Column:
    """Text as XML content."""
    return F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def documents(rows: DataFrame, feed: str, order: str, each: int = 50) -> DataFrame:
    """value: RSS documents of at most `each` items (title, link, description; XML already) of a feed, in order; long feeds go on in further documents."""
    place = F.row_number().over(Window.partitionBy(feed).orderBy(order)) - 1
    item = F.concat(F.lit("<item><title>"), "title", F.lit("</title><link>"), "link", F.lit("</link><description>"), "description", F.lit("</description></item>"))
    cut = rows.select(feed, F.floor(place / each).alias("part"), F.struct(F.col(order).alias("o"), item.alias("i")).alias("item"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda x: x["i"]), "\n")
    channel = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0"><channel><title>'), escaped(F.col(feed)), F.lit("</title>\n"), body, F.lit("\n</channel></rss>"))
    return cut.groupBy(feed, "part").agg(channel.alias("value")).select("value")
