"""The XML reader beside the pattern reader: namespaces, attributes, CDATA, and items that are no XML among good ones."""

from pyspark.sql import functions as F

from presswire.sources import xml_feeds

RSS = """<?xml version="1.0"?><rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>Feed</title>
<item><title>One &amp; only</title><link>https://www.example.com/a/</link><description><![CDATA[<b>First</b> & last]]></description><pubDate>Wed, 04 Feb 2026 10:00:00 +0000</pubDate></item>
<item><title>Two & more</title><link>https://example.com/b</link><summary>Second</summary><pubDate>nonsense</pubDate></item>
<item><title> Three </title><dc:date>2026-02-01T08:30:00Z</dc:date><link/><description/></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><entry><title>Four</title><link rel="self" href="https://example.org/self"/><link rel="alternate" href="https://example.org/g?x&amp;y"/>
<updated>2026-02-01T08:30:00+01:00</updated><summary>Fourth</summary></entry><entry><title>Five</title><link href="https://example.org/h"/><published>2026-02-02</published></entry></feed>"""


def test_items(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text(ATOM)
    rows = xml_feeds.items(spark, str(tmp_path)).withColumn("s", F.unix_seconds("published")).withColumn("f", F.regexp_extract("file", "([ab])[.]xml", 1)).orderBy("f", "item_pos").collect()
    assert [(r["f"], r["item_pos"], r["title"], r["url"], r["domain"], r["summary"], r["parsed"]) for r in rows] == [
        ("a", 0, "One & only", "https://www.example.com/a/", "example.com", "<b>First</b> & last", True), ("a", 1, "Two & more", "https://example.com/b", "example.com", "Second", False), ("a", 2, "Three", "", "", "", True),
        ("b", 0, "Four", "https://example.org/g?x&y", "example.org", "Fourth", True), ("b", 1, "Five", "https://example.org/h", "example.org", "", True),
    ]
    assert [r["s"] for r in rows][:4] == [1770199200, None, 1769934600, 1769931000]


def test_long_feeds_go_on_in_further_documents(spark, tmp_path):
    rows = spark.range(120).select(F.lit("a < b").alias("host"), "id", F.col("id").cast("string").alias("title"), F.concat(F.lit("https://x.example/"), "id").alias("link"), F.lit("").alias("description"))
    docs = xml_feeds.documents(rows, "host", "id")
    assert docs.count() == 3
    docs.write.text(str(tmp_path / "docs"))
    out = xml_feeds.items(spark, str(tmp_path / "docs"))
    assert sorted(int(r["title"]) for r in out.collect()) == list(range(120)) and out.where("not parsed").isEmpty()
