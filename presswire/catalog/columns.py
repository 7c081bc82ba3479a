"""Functions of settings, links, prices, errors, reports, replies and profiles over columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswire import dims
from presswire.catalog.lookups import ERRORS, _redact_sql
from presswire.functions import models, reports, text, urls
from presswire.sources import feeds, profiles, sinks


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_redaction(spark, sf_dir):
    """Documents between a key and a bearer token, as logs hold them."""
    body = F.coalesce("text", F.lit(""))
    message = F.concat(F.lit("api_key="), F.md5(body), F.lit(" "), body, F.lit(" Authorization: Bearer "), "source")
    out = read(spark, sf_dir, "documents").select("doc_id", text.redact(message).alias("r"))
    return out.select("doc_id", F.md5("r").alias("redacted_md5"), text.count_of(F.col("r"), F.lit("[REDACTED]")).alias("n"))


def page_video_links(spark, sf_dir):
    """A video of each page, linked to in one of five ways."""
    forms = F.array(*map(F.lit, ["https://www.youtube.com/watch?v=ID&t=1", "https://youtu.be/ID", "https://www.youtube.com/embed/ID?x", "https://youtube.com/shorts/ID", "https://example.com/ID"]))
    link = F.replace(F.element_at(forms, F.length("url") % 5 + 1), F.lit("ID"), F.substring(F.md5("url"), 1, 11))
    return read(spark, sf_dir, "pages").select("page_id", F.coalesce(reports.youtube_id(link), F.lit("")).alias("video_id"))


def part_values(spark, sf_dir):
    setting = F.concat(F.lit(" "), "p_name", F.lit(",, "), "p_brand", F.lit("\n\n"), "p_type", F.lit(" ,"))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(text.split_values(setting), "|").alias("parts"))


def page_server_urls(spark, sf_dir):
    address = F.concat(F.lit(" "), "url", F.when(F.length("url") % 2 == 0, "/v1//").otherwise("/"))
    return read(spark, sf_dir, "pages").select("page_id", urls.with_v1(address).alias("base_url"))


def page_bridge_errors(spark, sf_dir):
    """Page addresses as bridge settings: at their own host, at hosts that are local, forbidden or not filled in."""
    hosts = F.array(F.regexp_extract("url", r"//([^/]+)", 1), F.lit("localhost:8787"), F.lit("0.0.0.0"), F.lit("<host>"), F.lit("localhost:99999"))
    address = F.concat(F.lit("http://"), F.element_at(hosts, F.length("url") % 5 + 1), F.lit("/v1"))
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(urls.bridge_errors(address), " ").alias("errors"))


def event_backoff(spark, sf_dir):
    message = F.when(F.col("event_type") == "error", F.concat(F.lit("please Retry in "), F.floor(F.abs("value")).cast("string"), F.lit("s"))).otherwise("none")
    return read(spark, sf_dir, "events").select("event_id", models.backoff(F.pmod("user_id", F.lit(5)), message).alias("delay"))


def event_error_classes(spark, sf_dir):
    """Events as errors of ten kinds, by user."""
    kinds = spark.createDataFrame(ERRORS, "kind int, s int, m string, p string")
    rows = read(spark, sf_dir, "events").select("event_type", F.pmod("user_id", F.lit(len(ERRORS))).cast("int").alias("kind")).join(F.broadcast(kinds), "kind")
    m = F.col("m")
    classes = {"router": models.router_rate_limited(F.col("s"), m), "service": models.service_rate_limited(m, F.lit("Error")), "quota_zero": models.quota_zero(m), "not_found": models.model_not_found(F.col("p"), m)}
    return rows.groupBy("event_type").agg(*[F.count_if(c).alias(n) for n, c in classes.items()])


def event_http_status(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "rate_limit").when(F.col("event_type") == "purchase", "budget").when(F.col("event_type") == "click", "not_found").otherwise(F.col("event_type"))
    return read(spark, sf_dir, "events").groupBy(models.http_status(kind).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def part_prices(spark, sf_dir):
    """Parts as models: sizes as prices, of which catalogues give a millionth as text."""
    price = lambda c: models.price_per_million((F.col(c) / 1_000_000_000).cast("string"))
    provider = F.when(F.col("p_size") % 2 == 0, "openrouter").otherwise("groq")
    return read(spark, sf_dir, "part").select("p_partkey", models.price_label(F.col("p_brand"), provider, F.round(price("p_size"), 6), F.round(price("p_partkey"), 6)).alias("label"))


def document_reports(spark, sf_dir):
    """A report for each document: its own source in the matrix, its neighbour's in a footnote where the text is of odd length."""
    link = lambda n: F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), n.cast("string"))
    body = F.coalesce("text", F.lit(""))
    own, other = link(F.col("doc_id")), link(F.col("doc_id") + F.length(body) % 2)
    lines = ["# Report", "", "## Source Matrix", "", "| Outlet | Bias | Link |", "| --- | --- | --- |"]
    report = F.concat(F.lit("\n".join(lines) + "\n| "), "source", F.lit(" | 0 | [x]("), own, F.lit(") |\n\n## Notes\n\n[^1]: see "), other, F.lit(".\n"))
    rows = read(spark, sf_dir, "documents").select("doc_id", report.alias("r"), F.array(own).alias("allowed"))
    return rows.select("doc_id", F.coalesce(reports.report_error(F.col("r"), F.col("allowed")), F.lit("")).alias("error"), F.array_join(reports.footnote_urls(F.col("r")), " ").alias("notes"), F.coalesce(sinks.matrix_csv(F.col("r")), F.lit("")).alias("csv"))


def page_search_replies(spark, sf_dir):
    """Pages as replies of a search service, JSON of at most thirty results each: the first ten of each, with what their fields fall back to."""
    rows = read(spark, sf_dir, "pages").select("page_id", "url", F.floor(F.col("page_id") / 30).alias("query_pos"), F.substring("html", 16, 20).alias("content"))
    result = F.struct("page_id", F.lit("t").alias("title"), "url", F.when(F.length("url") % 2 == 0, F.col("content")).alias("content"), F.lit("snip").alias("snippet"), F.when(F.length("url") % 3 == 0, F.lit("eng")).alias("engine"))
    replies = rows.groupBy("query_pos").agg(F.to_json(F.struct(F.array_sort(F.collect_list(result)).alias("results"))).alias("json"))
    out = feeds.search_results(replies)
    return out.select("query_pos", F.col("result_pos").cast("long").alias("result_pos"), "url", "snippet", "source")


def supplier_profiles(spark, sf_dir):
    """Suppliers as channel profiles, written as YAML and read back."""
    rows = read(spark, sf_dir, "supplier").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    made = rows.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat("s_name", F.lit(" of "), "n_name", F.lit("\nsecond line: kept")).alias("description"), F.lower("n_name").alias("worldview"), F.lit("").alias("worldview_description"), F.array("n_name", F.lit("Law")).alias("topics"))
    back = profiles.from_yaml(profiles.to_yaml(made))
    return back.select("id", "name", "description", "worldview", F.array_join("topics", "|").alias("topics"))


_LINK = lambda n: f"'https://' || source || '.example/' || ({n})"
_OTHER = _LINK("doc_id + length(coalesce(text, '')) % 2")
_REDACTED = _redact_sql("'api_key=' || md5(coalesce(text, '')) || ' ' || coalesce(text, '') || ' Authorization: Bearer ' || source")
_NETLOC = "regexp_extract(url, '//([^/]+)', 1)"
_PRICE = lambda x: f"regexp_replace(printf('%.4f', {x} / 1000.0), '\\.?0+$', '')"

QUERIES = {
    "document_redaction": (document_redaction, f"select doc_id, md5(r) as redacted_md5, ((length(r) - length(replace(r, '[REDACTED]', ''))) // 10)::integer as n from (select doc_id, {_REDACTED} as r from documents)"),
    "page_video_links": (page_video_links, "select page_id, case when length(url) % 5 = 4 then '' else left(md5(url), 11) end as video_id from pages"),
    "part_values": (part_values, "select p_partkey, p_name || '|' || p_brand || '|' || p_type as parts from part"),
    "page_server_urls": (page_server_urls, "select page_id, regexp_replace(url, case when length(url) % 2 = 0 then '$' else '/*$' end, '') || '/v1' as base_url from pages"),
    "page_bridge_errors": (page_bridge_errors, f"select page_id, case length(url) % 5 when 0 then 'not_local public' when 1 then '' when 2 then 'blocked_host not_local public' when 3 then 'placeholder' else 'bad_port' end as errors from pages where {_NETLOC} <> ''"),
    "event_backoff": (event_backoff, "select event_id, least(greatest(5 * pow(2, user_id % 5), case when event_type = 'error' then floor(abs(value)) else 0 end), 120)::double as delay from events"),
    "event_error_classes": (event_error_classes, f"""select event_type, count(*) filter (k in (0, 1, 2, 8)) as router, count(*) filter (k in (1, 5)) as service, count(*) filter (k in (3, 4)) as quota_zero, count(*) filter (k = 6) as not_found
        from (select event_type, user_id % {len(ERRORS)} as k from events) group by 1"""),
    "event_http_status": (event_http_status, "select case event_type when 'error' then 429 when 'purchase' then 402 when 'click' then 404 else 500 end::integer as status, count(*) as n from events group by 1"),
    "part_prices": (part_prices, f"select p_partkey, case when p_size % 2 <> 0 then p_brand when p_size = 0 and p_partkey = 0 then p_brand || ' (Free)' else p_brand || ' ($' || {_PRICE('p_size')} || '/$' || {_PRICE('p_partkey')} || ' per 1M)' end as label from part"),
    "document_reports": (document_reports, f"""select doc_id, case when length(coalesce(text, '')) % 2 = 1 then 'footnotes outside matrix: ' || {_OTHER} else '' end as error, {_OTHER} as notes,
        'Outlet,Bias,Link' || chr(13) || chr(10) || source || ',0,[x](' || {_LINK('doc_id')} || ')' as csv from documents"""),
    "page_search_replies": (page_search_replies, f"""select query_pos, result_pos, url, case when length(url) % 2 = 0 then content else 'snip' end as snippet, case when length(url) % 3 = 0 then 'eng' else {_NETLOC} end as source
        from (select page_id // 30 as query_pos, row_number() over (partition by page_id // 30 order by page_id) - 1 as result_pos, url, html[16:35] as content from pages) where result_pos < 10"""),
    "supplier_profiles": (supplier_profiles, "select s_suppkey as id, s_name as name, s_name || ' of ' || n_name || chr(10) || 'second line: kept' as description, lower(n_name) as worldview, n_name || '|Law' as topics from supplier join nation on s_nationkey = n_nationkey"),
}
