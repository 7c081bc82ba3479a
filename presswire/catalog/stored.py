"""Queries that write: rows go to the shared folder through a sink and are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswire import streaming
from presswire.catalog.feeds import _DOMAIN, TITLE, pages
from presswire.catalog.stories import ARTICLES, articles
from presswire.functions import text
from presswire.operators import keywords
from presswire.sources import sinks, versioned, xml_feeds


def place(spark) -> str:
    return f"{streaming.temporary(spark, streaming.folder(spark))}/table"


def stored_stories(spark, sf_dir):
    """Articles as new stories, inserted twice: ids come from the natural key, so the second insert shows as violations and not as other rows."""
    rows = articles(spark, sf_dir).select(F.concat_ws(" ", "outlet", "pos").alias("title"), F.substring("text", 1, 50).alias("description"), F.array("outlet", "category").alias("keywords"))
    path = place(spark)
    for _ in range(2):
        sinks.append(sinks.stories(rows), path)
    out = spark.read.parquet(path)
    return out.groupBy("id", "title", "status").agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.from_json("keywords", "array<string>"))).alias("n_keywords"))


def stored_sources(spark, sf_dir):
    rows = articles(spark, sf_dir).select(
        F.col("story_id").cast("string").alias("story_id"), F.lower("outlet").alias("domain"), F.concat(F.lit("https://x.example/"), "pos").alias("url"), F.substring("text", 1, 600).alias("title"), F.when(F.col("pos") % 3 != 0, F.col("text")).alias("full_text"),
        F.lit(None).cast("string").alias("author"), F.lit(None).cast("timestamp").alias("published_date"), F.col("bias").alias("political_bias"), F.when(F.col("bias").isNotNull(), 1.0).alias("bias_confidence"),
    )
    path = place(spark)
    sinks.append(sinks.sources(rows), path)
    return spark.read.parquet(path).select("id", "domain", F.length("title").alias("title_chars"), F.length("full_text").alias("text_chars"), "political_bias", "bias_confidence")


def stored_analyses(spark, sf_dir):
    """Reports are encoded twice on the way in and decoded twice on the way out."""
    rows = articles(spark, sf_dir).groupBy("story_id").agg(F.array_sort(F.collect_set("outlet")).alias("agreed_facts"), F.min("text").alias("t"))
    rows = rows.select(F.col("story_id").cast("string").alias("story_id"), "agreed_facts", F.lit(None).cast("array<string>").alias("left_only_facts"), F.array(F.lit('a "b"'), F.lit("c")).alias("right_only_facts"), F.to_json(F.struct(F.col("t").alias("summary"))).alias("full_report_json"))
    path = place(spark)
    sinks.append(sinks.analyses(rows), path)
    back = F.from_json(sinks.json_back(F.col("full_report_json")), "summary string")["summary"]
    return spark.read.parquet(path).select("story_id", F.size(F.from_json("agreed_facts", "array<string>")).alias("n_agreed"), "left_only_facts", "right_only_facts", F.length(back).alias("summary_chars"), F.md5(back).alias("summary_md5"))


def report_lines(spark, sf_dir):
    """Reports as text files, a folder a story: their lines."""
    report = F.concat(F.lit("# Story "), F.col("story_id").cast("string"), F.lit("\n\n"), F.array_join(F.array_sort(F.collect_set("outlet")), "\n"))
    rows = articles(spark, sf_dir).groupBy("story_id").agg(report.alias("full_report_md"))
    path = place(spark)
    sinks.report_files(rows, path)
    lines = spark.read.text(path)
    return lines.groupBy(F.col("story_id").cast("long").alias("story_id")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("value")).alias("n_chars"))


def feed_xml(spark, sf_dir):
    """Pages as RSS documents of their hosts, written and read back by the XML reader. Titles of every fourth page stand in them unescaped, as careless
    feeds have them, so those that hold an ampersand are no XML."""
    title = F.coalesce(text.html_title(F.col("html")), F.lit(""))
    rows = pages(spark, sf_dir).select("page_id", F.regexp_extract("url", r"//([^/]+)", 1).alias("host"), F.when(F.col("page_id") % 4 == 0, title).otherwise(xml_feeds.escaped(title)).alias("title"), xml_feeds.escaped(F.col("url")).alias("link"), F.lit("<![CDATA[<b>x</b> & y]]>").alias("description"))
    path = place(spark)
    xml_feeds.documents(rows, "host", "page_id").write.text(path)
    out = xml_feeds.items(spark, path)
    return out.select("url", F.md5("title").alias("title_md5"), "summary", "domain", (F.col("parsed") | F.col("title").contains("&")).alias("as_expected"))


def stored_upsert(spark, sf_dir):
    """Customers as a stored table, patched by what orders and suppliers say: each customer's latest order, then suppliers as new rows. The second patch is
    sent twice. version tells the rows of each version."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    path = place(spark)
    versioned.create(read("customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"), F.lit(None).cast("long").alias("last_order")), path, "id", 16)
    versioned.patch(read("orders").groupBy(F.col("o_custkey").cast("long").alias("id")).agg(F.max("o_orderkey").cast("long").alias("last_order")), path, "orders")
    more = read("supplier").select((-1 - F.col("s_suppkey")).cast("long").alias("id"), F.col("s_name").alias("name"))
    for _ in range(2):
        versioned.patch(more, path, "suppliers")
    parts = [versioned.read(spark, path, v).withColumn("version", F.lit(v)) for v in versioned.versions(spark, path)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]) if len(parts) == 3 else parts[0]
    return rows.groupBy("version").agg(F.count(F.lit(1)).alias("n"), F.count("last_order").alias("n_orders"), F.sum("last_order").alias("total"), F.max("name").alias("last_name"), F.min("id").alias("least_id"))


def term_scores(spark, sf_dir):
    out = keywords.term_scores(keywords.words(articles(spark, sf_dir), "pos", "text"), "pos")
    return out.select("pos", "term", "tf", F.round("score", 6).alias("score"))


def top_keywords(spark, sf_dir):
    """Ten keywords an article, near copies left out."""
    return keywords.keywords(articles(spark, sf_dir), "pos", "text").select("pos", "rank", "keyword", F.round("relevance", 6).alias("relevance"))


_VALID = f"(length(lower(word)) >= 3 and lower(word) not in ({', '.join(repr(w) for w in keywords.STOP)}) and not regexp_full_match(word, '\\p{{N}}+'))"
SCORED = f"""s as (select pos, list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]+'), lambda x: regexp_extract_all(x, '[\\p{{L}}\\p{{N}}]+')), lambda w: len(w) > 0) as ss from {ARTICLES} a where length(text) >= 20),
  q as (select pos, unnest(ss) as ws, unnest(range(len(ss))) as sent from s), w as (select pos, sent, unnest(ws) as word, unnest(range(len(ws))) as i from q),
  n as (select *, lower(word) as term, {_VALID} as valid, lag(lower(word)) over v as l, lead(lower(word)) over v as r, upper(word) = word and length(word) > 1 and not regexp_full_match(word, '\\p{{N}}+') as up from w window v as (partition by pos, sent order by i)),
  t as (select pos, term, count(*) as tf, count(*) filter (up) as nu, count(*) filter (not up and i > 0 and regexp_matches(word, '^\\p{{Lu}}')) as nc, count(distinct sent) as ns, median(sent) as middle,
    count(l) as nl, count(distinct l) as dl, count(r) as nr, count(distinct r) as dr, bool_or(valid) as valid from n group by pos, term),
  e as (select pos, avg(tf) filter (valid) as mean, stddev_pop(tf) filter (valid) as spread, max(tf) as most from t group by pos), c as (select pos, max(sent) + 1 as sentences from n group by pos),
  f as (select t.*, mean, spread, sentences, 1 + (case when nl > 0 then dl / nl else 0 end + case when nr > 0 then dr / nr else 0 end) * tf / most as related from t join e using (pos) join c using (pos) where valid),
  g as (select pos, term, tf, ln(ln(3 + middle)) * related / (greatest(nu, nc) / (1 + ln(tf)) + tf / (mean + spread) / related + ns / sentences / related) as score from f)"""
TERMS = f"with {SCORED} select pos, term, tf, round(score, 6) as score from g"
#: Greedy: a fold over a text's keywords in order that keeps up to twenty, none a near copy of one kept before.
KEYWORDS = f"""with {SCORED},
  p as (select pos, term as a, r as b, count(*) as n from n where valid and {_VALID.replace('lower(word)', 'r').replace('(word,', '(r,')} group by 1, 2, 3),
  k as (select pos, term as keyword, score / (tf * (1 + score)) as score from g union all
    select p.pos, a || ' ' || b, x.score * y.score / (n * (1 + x.score + y.score)) from p join g x on x.pos = p.pos and x.term = a join g y on y.pos = p.pos and y.term = b),
  l as (select pos, list([keyword] order by round(score, 12), keyword) as ks, map_from_entries(list((keyword, score))) as scores from k group by pos),
  v as (select pos, scores, list_reduce(list_prepend(['']::varchar[], ks), lambda acc, x: case when len(acc) > 20 or len(list_filter(acc[2:], lambda o: 1 - levenshtein(o, x[1]) / greatest(length(o), length(x[1])) > 0.9)) > 0 then acc else list_append(acc, x[1]) end)[2:11] as top from l),
  o as (select pos, scores, unnest(range(1, len(top) + 1))::integer as rank, unnest(top) as keyword from v)
  select pos, rank, keyword, round(1 - least(scores[keyword], 1), 6)::double as relevance from o"""

QUERIES = {
    "stored_upsert": (stored_upsert, """with o as (select o_custkey, max(o_orderkey) as last from orders group by 1), c as (select c_custkey as id, c_name as name, last from customer left join o on c_custkey = o_custkey
          union all select o_custkey, null, last from o where o_custkey not in (select c_custkey from customer)),
        v as (select 0 as version, c_custkey as id, c_name as name, null as last from customer union all select 1, * from c union all select 2, * from c union all select 2, -1 - s_suppkey, s_name, null from supplier)
        select version::integer as version, count(*) as n, count(last) as n_orders, sum(last)::bigint as total, max(name) as last_name, min(id)::bigint as least_id from v group by version"""),
    "feed_xml": (feed_xml, f"select url, md5(trim(coalesce({TITLE}, ''))) as title_md5, '<b>x</b> & y' as summary, {_DOMAIN('url')} as domain, true as as_expected from pages"),
    "stored_stories": (stored_stories, f"select sha256(outlet || ' ' || pos || chr(10) || left(text, 50)) as id, outlet || ' ' || pos as title, 'pending' as status, 2::bigint as n, 2 as n_keywords from {ARTICLES} a"),
    "stored_sources": (stored_sources, f"""select sha256(story_id || chr(10) || 'https://x.example/' || pos) as id, lower(outlet) as domain, least(length(text), 500)::integer as title_chars, case when pos % 3 <> 0 then length(text) else 0 end::integer as text_chars,
        coalesce(bias, 0)::integer as political_bias, case when bias is null then 0.0 else 1.0 end::double as bias_confidence from {ARTICLES} a"""),
    "stored_analyses": (stored_analyses, f"""select story_id::varchar as story_id, count(distinct outlet)::integer as n_agreed, '[]' as left_only_facts, '["a \\"b\\"","c"]' as right_only_facts, length(min(text))::integer as summary_chars, md5(min(text)) as summary_md5 from {ARTICLES} a group by story_id"""),
    "report_lines": (report_lines, f"select story_id::bigint as story_id, count(distinct outlet) + 2 as n_lines, (length('# Story ' || story_id) + sum(distinct_chars))::bigint as n_chars from (select story_id, outlet, length(outlet) as distinct_chars from {ARTICLES} a group by 1, 2) group by story_id"),
    "term_scores": (term_scores, TERMS),
    "top_keywords": (top_keywords, KEYWORDS),
}
