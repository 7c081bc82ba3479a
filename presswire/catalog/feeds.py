"""Queries over URLs, pages, feed items and search results. The pages table stands for both feed items and results."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswire import dims
from presswire.functions import text, urls
from presswire.operators import joins, keyword_join, ordered, store
from presswire.operators import seeds as seed_operator
from presswire.plans import discovery
from presswire.sources import feeds as feed_source

FEEDS = 10
TOPICS = ["tion", "quzx"]
NOW = "2026-02-05 12:00:00"

URL_EDGES = [
    (0, "HTTPS://Example.COM/Path/A/"), (1, "http://example.com:8080/x//"), (2, "http://user:pw@example.com/x;p=1?q#f"), (3, "example.com/no/scheme/"), (4, "http://a b.com/x y"),
    (5, "http://x|y.com/a|b"), (6, ""), (7, "mailto:someone@example.com"), (8, "//host/path"), (9, "http://www.www.example.com"), (10, "http://[::1]:80/p/"), (11, "https://WWW.Example.com/?a=1"),
]


def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def items(spark, sf_dir):
    """Pages as feed items: feed_pos, item_pos, title, url, summary (500 characters), published (null for every 7th)."""
    rows = pages(spark, sf_dir)
    published = F.when(F.col("page_id") % 7 != 0, F.lit(NOW).cast("timestamp_ntz") - F.make_interval(hours=(F.col("page_id") % 90).cast("int")))
    return rows.select(
        F.pmod("page_id", F.lit(FEEDS)).alias("feed_pos"), F.floor(F.col("page_id") / FEEDS).alias("item_pos"), F.coalesce(text.html_title(F.col("html")), F.lit("")).alias("title"),
        "url", F.substring(text.html_text(F.col("html")), 1, 500).alias("summary"), published.alias("published"),
    )


#: The same in SQL: ASCII white space and these entities, since the pages hold no others. amp comes last so that nothing is decoded twice.
PAGE_ENTITIES = [("quot", '"'), ("copy", "©"), ("middot", "·"), ("nbsp", "\u00a0"), ("lt", "<"), ("gt", ">"), ("#39", "'"), ("amp", "&")]
_CLEAN = lambda x: "trim(regexp_replace(" + "".join("regexp_replace(" for _ in PAGE_ENTITIES) + f"regexp_replace({x}, '<[^>]+>', ' ', 'g')" + "".join(f", '&{n};?', {dims.literal(c)}, 'g')" for n, c in PAGE_ENTITIES) + ", '[\\s\\xA0]+', ' ', 'g'))"
TITLE = _CLEAN("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
BODY = _CLEAN("regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<head\\b.*?</head>', ' ', 'g')")
ITEMS = f"""(select page_id % {FEEDS} as feed_pos, page_id // {FEEDS} as item_pos, coalesce(nullif({TITLE}, ''), '') as title, url, left({BODY}, 500) as summary,
  case when page_id % 7 <> 0 then timestamp '{NOW}' - to_hours((page_id % 90)::integer) end as published from pages)"""

_NETLOC = lambda u: f"regexp_extract({u}, '^\\s*(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1)"
_PATH = lambda u: f"regexp_replace(regexp_extract({u}, '^\\s*(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')"
_NORM = lambda u: f"lower(regexp_extract({u}, '^\\s*([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) || '://' || lower({_NETLOC(u)}) || regexp_replace({_PATH(u)}, '/+$', '')"
_DOMAIN = lambda u: f"replace({_NETLOC(u)}, 'www.', '')"


def url_keys(spark, sf_dir):
    u = F.col("url")
    return pages(spark, sf_dir).select("page_id", urls.normalize(u).alias("norm_url"), urls.domain(u).alias("domain"), urls.snippet_domain(u).alias("snippet_domain"))


def url_edges(spark, sf_dir):
    rows = spark.createDataFrame(URL_EDGES, "i int, u string")
    return rows.select("i", urls.normalize(F.col("u")).alias("norm_url"), urls.domain(F.col("u")).alias("domain"), urls.normalize_or_empty(F.col("u")).alias("norm_or_empty"))


def url_dedupe_first(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", urls.normalize(F.col("url")).alias("norm_url"))
    return ordered.keep_first(rows, ["norm_url"], ["page_id"])


def domain_counts_topk(spark, sf_dir):
    rows = pages(spark, sf_dir).select(F.lower(urls.domain(F.col("url"))).alias("domain"))
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "domain").limit(20)


def slug_keywords(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.array_join(urls.slug_keywords(F.col("url")), " ").alias("slug"))


_SLUG = lambda u: f"list_slice(list_filter(string_split_regex(lower(array_to_string(list_slice(list_filter(string_split({_PATH(u)}, '/'), lambda p: p <> ''), -2, -1), '-')), '[^a-zA-Z0-9]+'), lambda w: w <> '' and not list_contains({dims.literal(urls.SLUG_STOP)}, w)), 1, 6)"


def html_title_text(spark, sf_dir):
    t = text.html_text(F.col("html"))
    return pages(spark, sf_dir).select("page_id", text.html_title(F.col("html")).alias("title"), F.length(t).alias("n_chars"), F.md5(t).alias("text_md5"))


BLOCKED_PAGES = [
    (0, "Access Denied", "you shall not pass", "<html></html>"), (1, "Shop", "solve the CAPTCHA", "<p>x</p>"), (2, "Robot", "", ""), (3, "News", "bot detection active", ""), (4, "Hm", "Verify you are human", ""),
    (5, "", "a challenge", ""), (6, "", "", "<script src='https://geo.captcha-delivery.com/x'></script>"), (7, "", "", "DataDome"), (8, "Fine", "text", '<meta name="robots" content="index">'), (9, "Fine", "text", "<p>text</p>"),
]


def blocked_pages(spark, sf_dir):
    rows = spark.createDataFrame(BLOCKED_PAGES, "i int, title string, body string, html string")
    return rows.select("i", text.any_present(F.concat_ws("\n", "title", "body", "html"), text.BLOCKED).alias("blocked"))


def blocked_in_table(spark, sf_dir):
    return pages(spark, sf_dir).groupBy(text.any_present(F.col("html"), text.BLOCKED).alias("blocked")).agg(F.count(F.lit(1)).alias("n"))


def keyword_search_items(spark, sf_dir):
    """Items whose title or (cut) summary holds a keyword; read with blanks kept, as the service does, an empty one would match all."""
    keys = F.array(*map(F.lit, TOPICS))
    rows = items(spark, sf_dir)
    return rows.where(joins.contains_any(F.lower(F.concat_ws(" ", "title", "summary")), keys)).select("feed_pos", "item_pos", "url")


def keyword_table(spark, sf_dir):
    """Topics of a table: the last word of every page's title, of odd pages its first four letters."""
    last = F.regexp_extract(text.html_title(F.col("html")), r"([^ ]+)$", 1)
    return pages(spark, sf_dir).select(F.when(F.col("page_id") % 2 == 0, last).otherwise(F.substring(last, 1, 4)).alias("topic")).where("topic <> ''")


def keyword_table_items(spark, sf_dir):
    """Items with the topics that their title or summary holds: how many, and the first."""
    rows = store.cut(items(spark, sf_dir).select("feed_pos", "item_pos", F.concat_ws(" ", "title", "summary").alias("words")))  # pages are parsed once
    hits = keyword_join.contained_keywords(rows, "words", keyword_table(spark, sf_dir), "topic")
    return hits.groupBy("feed_pos", "item_pos").agg(F.count(F.lit(1)).alias("n_topics"), F.min("topic").alias("first_topic"))


def freshness_filter(spark, sf_dir):
    return items(spark, sf_dir).where(ordered.fresh(F.col("published"), F.lit(NOW).cast("timestamp_ntz"), 24)).select("feed_pos", "item_pos")


def capped_then_filtered(spark, sf_dir):
    """The cap comes before the age: items that fall out do not make room."""
    rows = ordered.cap(items(spark, sf_dir), ["feed_pos"], ["item_pos"], 5)
    return rows.where(ordered.fresh(F.col("published"), F.lit(NOW).cast("timestamp_ntz"), 24)).select("feed_pos", "item_pos")


def candidate_feeds(spark, sf_dir):
    domains = spark.createDataFrame([(d,) for d in ("nytimes.com", "cnn.com", "foxnews.com", "wsj.com", "thehill.com", "unknown.example")], "domain string")
    return joins.candidate_feeds(domains, dims.feeds(spark))


def feed_catalogue(spark, sf_dir):
    """Feeds a category and their mean bias."""
    return dims.feeds(spark).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("bias"), 4).alias("mean_bias"))


_FEEDS = dims.values_sql([(i, *f) for i, f in enumerate(dims.FEEDS)], "feed_pos, category, name, url, bias")


def seeds(spark, sf_dir):
    """Every page's URL, with query and slash added, as a seed; its title as the hint."""
    rows = pages(spark, sf_dir)
    return rows.select(F.col("page_id").alias("seed_id"), F.concat("url", F.lit("/?utm=1")).alias("url"), text.html_title(F.col("html")).alias("title_hint"))


def seed_exact_match(spark, sf_dir):
    return joins.exact_seed(seeds(spark, sf_dir), items(spark, sf_dir)).select("seed_id", "feed_pos", "item_pos", "match_type", "match_confidence")


def seed_slug_match(spark, sf_dir):
    """The best item by share of the tokens of a seed's slug or title."""
    out = joins.similar_seed(seeds(spark, sf_dir), items(spark, sf_dir))
    return out.select("seed_id", "feed_pos", "item_pos", F.round("match_confidence", 6).alias("match_confidence"))


def seed_recovery(spark, sf_dir):
    """Pages are items of their host's feed, newest first, and seeds: by their own address with a query, by a headline's slug at their host without
    the www, or by that slug at a host without a feed."""
    title = F.coalesce(text.html_title(F.col("html")), F.lit(""))
    parsed = store.cut(pages(spark, sf_dir).select("page_id", "url", F.regexp_extract("url", r"//([^/]+)", 1).alias("host"), title.alias("title"), F.substring(text.html_text(F.col("html")), 1, 500).alias("summary")))
    feeds = parsed.select("host").distinct().select((F.row_number().over(Window.orderBy("host")) - 1).alias("feed_pos"), "host", F.concat(F.lit("News of "), "host").alias("name"), F.concat(F.lit("https://"), "host", F.lit("/feed.xml")).alias("url"))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("page_id"))) - 1
    items = parsed.withColumn("item_pos", place).join(feeds.select("feed_pos", "host"), "host").select("feed_pos", "item_pos", "title", "url", "summary")
    slug, form = F.concat(F.lit("/news/"), F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-")), F.pmod("page_id", F.lit(8))
    here = F.concat(F.lit("https://"), F.regexp_replace("host", r"^(www|m|blog)\.", ""), slug)
    url = F.when(form < 4, F.concat("url", F.lit("/?utm=1"))).when(form < 7, here).otherwise(F.concat(F.lit("https://elsewhere.invalid"), slug))
    seeds = parsed.select(F.col("page_id").alias("seed_id"), url.alias("url"), F.when(form == 3, F.col("title")).alias("title_hint"))
    out = seed_operator.recover(seeds, feeds, items)
    return out.select("seed_id", "feed_pos", "item_pos", "match_type", F.round("match_confidence", 6).alias("match_confidence"))


_TOKENS = lambda x: f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]{{3,}}')), lambda t: not list_contains({dims.literal(text.TOKEN_STOP)}, t))"


def extraction_first_success(spark, sf_dir):
    """Four attempts a page; ok from 100 characters on. The last attempt stands if none is."""
    rows = pages(spark, sf_dir).select("page_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("method_rank"))
    length = F.pmod(F.col("page_id") * 37 + F.col("method_rank") * 61, F.lit(180))
    attempts = rows.withColumn("text_length", length)
    return ordered.first_success(attempts, "page_id", F.col("text_length") > 100, "method_rank").select("page_id", "method_rank", F.col("text_length").cast("long").alias("text_length"))


def results(spark, sf_dir):
    """Pages as search results: query_pos, kind (some queries have few news), result_pos."""
    q = F.pmod("page_id", F.lit(12))
    return pages(spark, sf_dir).select(q.alias("query_pos"), F.when(q % 3 == 0, "web").when(F.col("page_id") < 24, "web").otherwise("news").alias("kind"), F.floor(F.col("page_id") / 12).alias("result_pos"), "url")


RESULTS = "(select page_id % 12 as query_pos, case when page_id % 12 % 3 = 0 then 'web' when page_id < 24 then 'web' else 'news' end as kind, page_id // 12 as result_pos, url from pages)"


def conditional_web_union(spark, sf_dir):
    return discovery.news_then_web(results(spark, sf_dir)).select("query_pos", "kind", "result_pos")


def discovery_prefetch(spark, sf_dir):
    return discovery.prefetch(items(spark, sf_dir), results(spark, sf_dir), TOPICS, F.lit(NOW).cast("timestamp_ntz"), 30)


def rss_records(spark, sf_dir):
    return discovery.feed_records(items(spark, sf_dir), TOPICS, F.lit(NOW).cast("timestamp_ntz")).select("feed_pos", "item_pos", "key")


RECORDS = f"""(select feed_pos, item_pos, key from (select *, row_number() over (partition by key order by feed_pos, item_pos) as kn from (
  select *, case when coalesce(url, '') = '' then '' else {_NORM('url')} end as key from (select *, row_number() over (partition by feed_pos order by item_pos) as rn from {ITEMS} i) c
  where rn <= 10 and (published is null or published > timestamp '{NOW}' - interval 48 hour) and ({' or '.join(f"contains(lower(title || ' ' || summary), '{t}')" for t in TOPICS)})) k where key <> '') x where kn = 1)"""


RSS = """<?xml version="1.0"?><rss><channel><title>Feed</title>
<item><title>One &amp; only</title><link>https://www.example.com/a/</link><description><![CDATA[<b>First</b> summary]]></description><pubDate>Wed, 04 Feb 2026 10:00:00 +0000</pubDate></item>
<item><title>Two</title><link>https://example.com/b</link><summary>Second</summary><description>other</description><pubDate>nonsense</pubDate></item>
<item><title>It&rsquo;s &#8220;five&#x201D; &mdash; &lt;b&gt;</title><link>https://example.com/e?a=1&amp;b=2</link><description>&lt;p&gt;a&amp;nbsp;b&lt;/p&gt;</description><pubDate>Wed, 04 Feb 2026 10:00 GMT</pubDate></item>
<item><title><![CDATA[Six &amp; more]]></title><link>https://example.com/f</link><dc:date>2026-02-01T08:30:00.123Z</dc:date></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Three</title><link href="https://www.example.org/c"/><updated>2026-02-01T08:30:00+01:00</updated><summary>Third</summary></entry><entry><title>Four</title></entry>
<entry><title>Seven</title><link rel="self" href="https://example.org/self"/><link rel="alternate" href="https://example.org/g?x&amp;y"/><published>2026-02-01T08:30Z</published></entry></feed>"""


def feed_documents(spark, sf_dir):
    docs = spark.createDataFrame([(0, RSS, "RSS", 1), (1, ATOM, "Atom", -2)], "feed_pos int, xml string, name string, bias int")
    rows = feed_source.items(docs)
    return rows.select("feed_pos", "item_pos", "title", "url", "domain", F.coalesce(F.unix_seconds("published"), F.lit(-1)).alias("published_s"), "summary", "bias", "source_name")


FEED_ROWS = [
    (0, 0, "One & only", "https://www.example.com/a/", "example.com", 1770199200, "<b>First</b> summary", 1, "RSS"), (0, 1, "Two", "https://example.com/b", "example.com", -1, "Second", 1, "RSS"),
    (0, 2, "It’s “five” — <b>", "https://example.com/e?a=1&b=2", "example.com", 1770199200, "<p>a&nbsp;b</p>", 1, "RSS"), (0, 3, "Six &amp; more", "https://example.com/f", "example.com", 1769934600, "", 1, "RSS"),
    (1, 0, "Three", "https://www.example.org/c", "example.org", 1769931000, "Third", -2, "Atom"), (1, 1, "Four", "", "", -1, "", -2, "Atom"), (1, 2, "Seven", "https://example.org/g?x&y", "example.org", 1769934600, "", -2, "Atom"),
]

SEARCH = [
    (0, '{"results": [{"title": "A", "url": "https://a.example/x", "content": "text", "engine": "eng"}, {"title": "B", "url": "https://b.example/y", "content": "", "snippet": "snip", "source": "src"}, {"url": "https://c.example/z"}]}'),
    (1, "not json"),
]


def search_reply_rows(spark, sf_dir):
    return feed_source.search_results(spark.createDataFrame(SEARCH, "query_pos int, json string"))


SEARCH_ROWS = [(0, 0, "A", "https://a.example/x", "text", "eng"), (0, 1, "B", "https://b.example/y", "snip", "src"), (0, 2, "", "https://c.example/z", "", "c.example")]


def time_ranges(spark, sf_dir):
    return spark.createDataFrame([("d",), ("w",), ("m",), ("y",), ("",)], "code string").select("code", feed_source.time_range(F.col("code")).alias("range"))


def user_agents(spark, sf_dir):
    rows = spark.createDataFrame([(0, "a || b ||  || c", 2), (1, "", 3), (2, "x", 0)], "i int, setting string, most int")
    return rows.select("i", F.array_join(feed_source.user_agents(F.col("setting"), F.col("most")), "|").alias("agents"))


def query_builder_dedupe(spark, sf_dir):
    data = [(0, "Vote on bill", "Senate Vote", None, "senate vote bill", "vote bill"), (1, "  ", "Title", None, None, "title"), (2, "Topic", "", "RSS title", None, "TOPIC"), (3, "", "", None, None, None)]
    rows = spark.createDataFrame(data, "i int, story string, title string, rss string, summary string, slug string")
    made = discovery.aggregator_queries(F.col("story"), F.col("title"), F.col("rss"), F.col("summary"), F.col("slug"))
    return rows.select("i", F.array_join(made, "; ").alias("queries"))


QUERY_ROWS = [(0, 'Vote on bill; "Senate Vote"; Senate Vote Vote on bill; senate vote bill'), (1, '"Title"; title'), (2, 'Topic; "RSS title"; RSS title Topic'), (3, "")]


def discovery_query_builder(spark, sf_dir):
    rows = spark.createDataFrame([(0, [" a ", "b", "", "c", "d", "A B c", "e", "f"]), (1, []), (2, ["x", "X", "x y"])], "i int, topics array<string>")
    return rows.select("i", F.array_join(discovery.discovery_queries(F.col("topics")), "; ").alias("queries"))


DISCOVERY_ROWS = [(0, "a b c; a; b; c; d"), (1, "breaking news politics"), (2, "x X x y; x; x y")]


def items_per_day(spark, sf_dir):
    """Running number of items a feed by age."""
    rows = items(spark, sf_dir).where("published is not null").select("feed_pos", "item_pos", F.to_date("published").alias("day"))
    own = Window.partitionBy("feed_pos").orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("feed_pos", "item_pos", F.date_format("day", "yyyy-MM-dd").alias("day"), F.count(F.lit(1)).over(own).alias("so_far"))


QUERIES = {
    "url_keys": (url_keys, f"select page_id, {_NORM('url')} as norm_url, {_DOMAIN('url')} as domain, lower(split_part({_NORM('url')}, '/', 3)) as snippet_domain from pages"),
    "url_edges": (url_edges, f"select i, {_NORM('u')} as norm_url, {_DOMAIN('u')} as domain, case when u = '' then '' else {_NORM('u')} end as norm_or_empty from {dims.values_sql(URL_EDGES, 'i, u')}"),
    "url_dedupe_first": (url_dedupe_first, f"select min(page_id) as page_id, norm_url from (select page_id, {_NORM('url')} as norm_url from pages) group by norm_url"),
    "domain_counts_topk": (domain_counts_topk, f"select lower({_DOMAIN('url')}) as domain, count(*) as n from pages group by 1 order by n desc, domain limit 20"),
    "slug_keywords": (slug_keywords, f"select page_id, array_to_string({_SLUG('url')}, ' ') as slug from pages"),
    "html_title_text": (html_title_text, f"select page_id, nullif({TITLE}, '') as title, length({BODY})::integer as n_chars, md5({BODY}) as text_md5 from pages"),
    "blocked_pages": (blocked_pages, f"select i, {' or '.join(f'''contains(lower(title || chr(10) || body || chr(10) || html), '{s}')''' for s in text.BLOCKED)} as blocked from {dims.values_sql(BLOCKED_PAGES, 'i, title, body, html')}"),
    "blocked_in_table": (blocked_in_table, f"select {' or '.join(f'''contains(lower(html), '{s}')''' for s in text.BLOCKED)} as blocked, count(*) as n from pages group by 1"),
    "keyword_search_items": (keyword_search_items, f"""select feed_pos, item_pos, url from {ITEMS} i where {' or '.join(f"contains(lower(title || ' ' || summary), '{t}')" for t in TOPICS)}"""),
    "keyword_table_items": (keyword_table_items, f"""with k as (select distinct lower(case when page_id % 2 = 0 then w else left(w, 4) end) as topic from (select page_id, regexp_extract({TITLE}, '([^ ]+)$', 1) as w from pages) x where w <> '')
        select feed_pos, item_pos, count(*) as n_topics, min(topic) as first_topic from (select *, lower(title || ' ' || summary) as words from {ITEMS} i) t join k on contains(words, topic) group by 1, 2"""),
    "freshness_filter": (freshness_filter, f"select feed_pos, item_pos from {ITEMS} i where published is null or published > timestamp '{NOW}' - interval 24 hour"),
    "capped_then_filtered": (capped_then_filtered, f"select feed_pos, item_pos from (select *, row_number() over (partition by feed_pos order by item_pos) as rn from {ITEMS} i) where rn <= 5 and (published is null or published > timestamp '{NOW}' - interval 24 hour)"),
    "candidate_feeds": (candidate_feeds, f"""with d(domain) as (values ('nytimes.com'), ('cnn.com'), ('foxnews.com'), ('wsj.com'), ('thehill.com'), ('unknown.example')),
        h as (select * from {dims.values_sql(dims.DOMAIN_HINTS, 'hint_domain, hints')}),
        p as (select domain, feed_pos, lower({_DOMAIN('url')}) as host, lower(name || ' ' || url) as words, coalesce(hints, []) as hints from d left join h on domain = hint_domain cross join {_FEEDS} f),
        m as (select *, contains(host, domain) or contains(domain, host) or len(list_filter(hints, lambda x: contains(words, x))) > 0 as hit from p)
        select domain, feed_pos::integer as feed_pos from m where hit or not (select bool_or(n.hit) from m n where n.domain = m.domain)"""),
    "feed_catalogue": (feed_catalogue, f"select category, count(*) as n, round(avg(bias), 4) as mean_bias from {_FEEDS} f group by category"),
    "seed_exact_match": (seed_exact_match, f"""with k as (select {_NORM('url')} as key, feed_pos, item_pos, row_number() over (partition by {_NORM('url')} order by feed_pos, item_pos) as rn from {ITEMS} i)
        select page_id as seed_id, feed_pos, item_pos, 'exact_url' as match_type, 1.0::double as match_confidence from (select page_id, url || '/?utm=1' as url from pages) s join k on {_NORM('s.url')} = key and rn = 1"""),
    "seed_slug_match": (seed_slug_match, f"""with i as (select *, {_TOKENS("title || ' ' || summary || ' ' || url")} as t from {ITEMS} x), s as (select page_id as seed_id, {_TOKENS(_PATH("url || '/?utm=1'"))} as u, {_TOKENS(f"coalesce(nullif({TITLE}, ''), '')")} as h from pages),
        c as (select seed_id, feed_pos, item_pos, greatest(len(list_intersect(u, t))::double / greatest(len(u), 1), 0.9::double * (len(list_intersect(h, t))::double / greatest(len(h), 1))) as sc from s join i on list_has_any(h, t) or list_has_any(u, t)),
        r as (select *, row_number() over (partition by seed_id order by sc desc, feed_pos, item_pos) as rn from c) select seed_id, feed_pos, item_pos, round(sc, 6) as match_confidence from r where rn = 1 and sc >= 0.45::double"""),
    "seed_recovery": (seed_recovery, f"""with p as (select *, regexp_extract(url, '//([^/]+)', 1) as host, coalesce(nullif({TITLE}, ''), '') as title, left({BODY}, 500) as summary from pages),
        f as (select host, row_number() over (order by host) - 1 as feed_pos, lower({_DOMAIN("'https://' || host || '/feed.xml'")}) as fhost from (select distinct host from p)),
        i as (select feed_pos, item_pos, {_NORM('url')} as item_key, {_TOKENS("title || ' ' || summary || ' ' || url")} as t from (select f.feed_pos, p.*, row_number() over (partition by p.host order by page_id desc) - 1 as item_pos from p join f using (host)) x where item_pos < 80),
        u as (select page_id as seed_id, title, page_id % 8 as form, case when page_id % 8 < 4 then url || '/?utm=1' when page_id % 8 < 7 then 'https://' || regexp_replace(host, '^(www|m|blog)\\.', '') || '/news/' || regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g')
          else 'https://elsewhere.invalid/news/' || regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g') end as url from p),
        s as (select seed_id, {_NORM('url')} as key, lower({_DOMAIN('url')}) as domain, {_TOKENS(_PATH('url'))} as u, {_TOKENS("case when form = 3 then title else '' end")} as h from u),
        d as (select domain, feed_pos, contains(fhost, domain) or contains(domain, fhost) as hit from (select distinct domain from s) cross join f),
        c as (select domain, feed_pos from d where hit or domain not in (select domain from d where hit)),
        m as (select seed_id, feed_pos, item_pos, case when key = item_key then 2 else greatest(len(list_intersect(u, t))::double / greatest(len(u), 1), 0.9::double * (len(list_intersect(h, t))::double / greatest(len(h), 1))) end as sc from s join c using (domain) join i using (feed_pos)),
        r as (select *, row_number() over (partition by seed_id order by sc desc, feed_pos, item_pos) as rn from m where sc >= 0.45::double)
        select seed_id, feed_pos::integer as feed_pos, item_pos::integer as item_pos, case when sc > 1.5 then 'exact_url' else 'slug_title' end as match_type, round(least(sc, 1), 6)::double as match_confidence from r where rn = 1"""),
    "extraction_first_success": (extraction_first_success, """with a as (select page_id, m as method_rank, (page_id * 37 + m * 61) % 180 as text_length from pages cross join range(4) r(m)),
        b as (select *, row_number() over (partition by page_id order by case when text_length > 100 then method_rank end nulls last, method_rank desc) as rn from a)
        select page_id, method_rank::integer as method_rank, text_length from b where rn = 1"""),
    "conditional_web_union": (conditional_web_union, f"select query_pos, kind, result_pos from (select *, count(*) filter (kind = 'news') over (partition by query_pos) as n from {RESULTS} r) where kind = 'news' or n < 4"),
    "discovery_rss_records": (rss_records, f"select feed_pos, item_pos, key from {RECORDS} r"),
    "discovery_prefetch": (discovery_prefetch, f"""with r as (select key, 0 as o, feed_pos as a, item_pos as b from {RECORDS} x order by feed_pos, item_pos limit 30),
        w as (select key, 1 as o, query_pos as a, result_pos as b, row_number() over (partition by key order by query_pos, result_pos) as kn from (select *, {_NORM('url')} as key from {RESULTS} y where starts_with(url, 'http')) z),
        e as (select key, o, a, b from w where kn = 1 and key not in (select key from r) and (select count(*) from r) < 18), u as (select * from r union all select * from e),
        n as (select *, row_number() over (order by o, a, b) as rank from u) select rank::integer as rank, key, case when o = 0 then 'rss' else 'search' end as origin from n where rank <= 30"""),
    "feed_documents": (feed_documents, f"select feed_pos, item_pos, title, url, domain, published_s::bigint as published_s, summary, bias, source_name from {dims.values_sql(FEED_ROWS, 'feed_pos, item_pos, title, url, domain, published_s, summary, bias, source_name')}"),
    "search_reply_rows": (search_reply_rows, f"select * from {dims.values_sql(SEARCH_ROWS, 'query_pos, result_pos, title, url, snippet, source')}"),
    "time_ranges": (time_ranges, "select code, case code when 'd' then 'day' when 'm' then 'month' else 'week' end as range from (values ('d'), ('w'), ('m'), ('y'), ('')) v(code)"),
    "user_agents": (user_agents, "select * from (values (0, 'a|b'), (1, ''), (2, 'x')) v(i, agents)"),
    "query_builder_dedupe": (query_builder_dedupe, f"select * from {dims.values_sql(QUERY_ROWS, 'i, queries')}"),
    "discovery_query_builder": (discovery_query_builder, f"select * from {dims.values_sql(DISCOVERY_ROWS, 'i, queries')}"),
    "items_per_day": (items_per_day, f"select feed_pos, item_pos, strftime(published, '%Y-%m-%d') as day, count(*) over (partition by feed_pos order by published::date range between unbounded preceding and current row) as so_far from {ITEMS} i where published is not null"),
}
