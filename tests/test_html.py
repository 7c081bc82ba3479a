"""Article extraction on pages that are written by hand: nesting, open tags, link lists, and what pages say of themselves."""

import datetime
import time

from pyspark.sql import functions as F

from presswire.functions import html, text

LONG = "This sentence has more than fifteen words so that it counts as a long block of an article by itself"


def one(spark, page, column=html.main_text):
    return spark.createDataFrame([(page,)], "html string").select(column(F.col("html")).alias("x")).first()["x"]


def test_main_text_leaves_out_what_surrounds_it(spark):
    page = f"""<html><head><title>T</title><style>p {{}}</style></head><body><div class="top-nav menu"><div><p>{LONG} menu.</p></div><p>{LONG} still menu.</p></div>
      <article class="story"><header><h1>The title of it</h1></header><p>{LONG} one.<p>{LONG} two &amp; <a href="/x">a link</a>.
      <aside><section><p>{LONG} aside.</p></section></aside><table><tr><td>{LONG} cell.</td></tr></table><p>{LONG} three.</p><script>var a = "<p>{LONG} script</p>";</script></article>
      <div id="comments"><p>{LONG} comment.</p></div><footer><div><p>{LONG} footer.</p></div></footer></body></html>"""
    assert one(spark, page).split("\n") == ["The title of it", f"{LONG} one.", f"{LONG} two & a link.", f"{LONG} three."]


def test_main_text_without_article_and_with_link_lists(spark):
    links = "<ul>" + "".join(f'<li><a href="/{i}">{LONG} link {i}</a></li>' for i in range(4)) + "</ul>"
    page = f"<body><div>{links}</div><div><p>{LONG}.</p><p>Three short words.</p><p>Then no</p><p>lonely words at end here.</p></div>{links}</body>"
    assert one(spark, page).split("\n") == [f"{LONG}.", "Three short words."]
    assert one(spark, f"<body>{links}</body>") is None


def test_main_text_of_broken_pages(spark):
    for page in (None, "", "plain", "<", "<p", "</div></div></div>", "<div" * 50, "<!-- open", "&&&"):
        assert one(spark, page) is None, page
    assert one(spark, f"</div></div><p>{LONG} <b>bold<p>{LONG} 5 < 6") == f"{LONG} bold\n{LONG} 5 < 6"
    assert one(spark, f"<nav><div><nav><p>{LONG} in.</p></nav><p>{LONG} in.</p></div></nav><p>{LONG} out.</p>") == f"{LONG} out."


def test_regions_over_many_chunks(spark):
    """The state goes on from chunk to chunk: one aside over some thousand tokens, deeper than the first chunk."""
    page = "<div>" * 300 + "<aside>" + f"<div><p>{LONG} in.</p></div>" * 700 + "</aside>" + f"<p>{LONG} out.</p>" + "</div>" * 300
    assert one(spark, page) == f"{LONG} out."


def test_metadata(spark):
    rows = [
        ('<meta name=author content=\'By Jane &amp; "Joe"\'><meta content="2026-02-05T01:02:03Z" property="article:published_time"><meta property="og:title" content="Better"><title>T</title>', "u", ("Better", 'Jane & "Joe"', "2026-02-05")),
        ('<title>T</title><meta name="author" content="http://x.example/jane"><span class="meta byline-name">By <b>Jane</b> Roe</span><time class="x" datetime="2026-03-01">', "u", ("T", "Jane Roe", "2026-03-01")),
        ('<script type="application/ld+json">{"author": [{"name": "A"}, {"name": "B"}], "datePublished": "2026-01-02"}</script>', "u", (None, "A", "2026-01-02")),
        ('<script type="application/ld+json">not json</script><meta name="date" content="5 May"><a rel="author" href="/j">Jane</a>', "https://x.example/2026/02/30/a", (None, "Jane", None)),
        ("<p>none</p>", "https://x.example/2026/02/28/a", (None, None, "2026-02-28")), ("", "", (None, None, None)), (None, None, (None, None, None)),
        ('<meta name="dc.date" content="2026-01-01"><meta name="date" content="2026-01-05"><meta name="date" content="2026-01-06">', "u", (None, None, "2026-01-05")),
    ]
    df = spark.createDataFrame([(i, p, u) for i, (p, u, _) in enumerate(rows)], "i int, page string, url string")
    got = {r["i"]: r["m"] for r in df.select("i", html.metadata(F.col("page"), F.col("url")).alias("m")).collect()}
    for i, (_, _, (title, author, date)) in enumerate(rows):
        assert tuple(got[i]) == (title, author, date and datetime.date.fromisoformat(date)), i


def test_entities_are_decoded_once_per_text(spark):
    """2,500 texts of 400 entities each: seconds, where a text that is split again for each entity takes minutes."""
    rows = spark.range(2500).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit(" a &amp; b &lt;c&gt; &#233;"), 100)).alias("t"))
    start = time.time()
    out = rows.select(text.unescape(F.col("t")).alias("x")).agg(F.sum(F.length("x")).alias("n"), F.min(F.instr("x", "&amp;")).alias("left")).first()
    assert time.time() - start < 20 and out["left"] == 0
    assert one(spark, "a &amp;amp; &eacute;&copy &#x41; &bogus; &", text.unescape) == "a &amp; é© A &bogus; &"
