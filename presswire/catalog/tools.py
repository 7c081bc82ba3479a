"""Queries for renderings, settings and message contents: tool texts, prompt blocks, envelopes, provider choices."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswire import dims
from presswire.catalog.feeds import ITEMS, items
from presswire.catalog.stories import ARTICLES, LABEL_CASE, articles
from presswire.operators import contents
from presswire.functions import models, rating, reports, urls
from presswire.operators.ordered import cap
from presswire.sources import catalogues


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def numbered_text(df, key, order, line, head, limit):
    """key, text: a head with the number of rows and the first `limit` lines, numbered in order."""
    rows = cap(df.withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(key))), [key], [order], limit)
    parts = rows.groupBy(key).agg(F.first("_all").alias("n"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))).alias("parts"))
    lines = F.transform("parts", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["t"]))
    return parts.select(key, F.concat(F.format_string(head, "n"), F.lit("\n"), F.array_join(lines, "\n")).alias("text"))


def feed_list_text(spark, sf_dir):
    """What the feed tool prints: the first 20 items of a feed with label, title, date and URL."""
    rows = items(spark, sf_dir).withColumn("bias", (F.col("feed_pos") - 4).cast("int"))
    line = F.concat(F.lit("["), rating.label(F.col("bias")), F.lit("] "), "title", F.lit("\n   Date: "), F.coalesce(F.date_format("published", "yyyy-MM-dd"), F.lit("Unknown")), F.lit("\n   URL: "), "url", F.lit("\n"))
    out = numbered_text(rows, "feed_pos", "item_pos", line, "Found %d news items:\n", 20)
    return out.select("feed_pos", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def source_context_text(spark, sf_dir):
    """The prompt block of a story's first five sources: title, domain, bias, 2000 characters of text."""
    rows = cap(articles(spark, sf_dir), ["story_id"], ["pos"], 5)
    bias = F.when(F.col("bias").isNull(), "Unknown").otherwise(F.concat(F.col("bias").cast("string"), F.lit(" ("), rating.label(F.col("bias")), F.lit(") via dataset")))
    block = F.concat_ws("\n", F.concat(F.lit("Domain: "), "outlet"), F.concat(F.lit("Bias: "), bias), F.lit("Text Excerpt:"), F.substring("text", 1, 2000), F.lit("-" * 40))
    parts = rows.groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))).alias("p"))
    text = F.array_join(F.transform("p", lambda x, i: F.concat(F.lit("Source "), (i + 1).cast("string"), F.lit(":\n"), x["b"])), "\n\n")
    return parts.select("story_id", F.length(text).alias("n_chars"), F.md5(text).alias("text_md5"))


def keyword_bars(spark, sf_dir):
    """Bars of ten for scores from 0 to 1, terms padded to 30."""
    rows = frame(spark, [(0, "economy", 0.95), (1, "a rather long keyword that overflows", 0.31), (2, "x", 0.0)], "i int, term string, score double")
    return rows.select("i", F.concat(F.lpad((F.col("i") + 1).cast("string"), 2, " "), F.lit(". "), F.when(F.length("term") < 30, F.rpad("term", 30, " ")).otherwise(F.col("term")), F.lit(" "), F.repeat(F.lit("█"), F.floor(F.col("score") * 10).cast("int"))).alias("line"))


MESSAGES = [
    (0, '"plain"'), (1, '{"text": "T", "output": "O"}'), (2, '{"output": "O"}'), (3, '[{"type": "text", "text": "a"}, "b", {"type": "input_text", "text": ""}, {"content": "c"}, {"output": "d"}, {"type": "image"}]'), (4, "null"), (5, '{"content": "deep"}'),
    (6, '[{"content": [{"type": "output_text", "text": "x"}, {"type": "text", "text": "y"}]}]'),
    (7, '{"content": [{"content": {"content": [{"content": "four deep"}]}}]}'),
]


def content_text(content, depth: int = 3):
    """Text of a message content (variant): a string, an object or a list of either, nested `depth` deep; what lies deeper counts if it is a string.

    Columns cannot recurse without end, so the depth is unrolled; messages of chat clients nest twice.
    """
    as_text = lambda v, path: F.try_variant_get(v, path, "string")
    keyed = F.coalesce(F.nullif(as_text(content, "$.text"), F.lit("")), F.nullif(as_text(content, "$.output"), F.lit("")))
    nested = F.try_variant_get(content, "$.content", "variant")
    parts = F.try_variant_get(content, "$", "array<variant>")
    plain = lambda v: F.when(F.schema_of_variant(v) == "STRING", as_text(v, "$"))
    inner = content_text(nested, depth - 1) if depth else plain(nested)

    def part(x):
        kind = F.coalesce(as_text(x, "$.type"), F.lit(""))
        below = F.try_variant_get(x, "$.content", "variant")
        deeper = content_text(below, depth - 1) if depth else plain(below)
        own = F.when(kind.isin("text", "input_text", "output_text"), as_text(x, "$.text")).when(below.isNotNull(), deeper).otherwise(as_text(x, "$.output"))
        return F.when(F.schema_of_variant(x) == "STRING", as_text(x, "$")).otherwise(F.nullif(own, F.lit("")))

    listed = F.array_join(F.filter(F.transform(parts, part), lambda t: t.isNotNull()), "\n")
    return F.when(F.schema_of_variant(content) == "STRING", as_text(content, "$")).when(parts.isNotNull(), listed).otherwise(F.coalesce(keyed, inner, F.lit("")))


def message_contents(spark, sf_dir):
    rows = frame(spark, MESSAGES, "i int, j string")
    return rows.select("i", F.coalesce(content_text(F.try_parse_json("j")), F.lit("")).alias("content"))


def nested_contents(spark, sf_dir):
    """Turns of conversations in contents that hold one another as often as the turn's number: a typed text at each level, the turn's own below all."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "turn", F.coalesce("text", F.lit("")).alias("own"))
    n = F.col("turn")
    quoted = F.regexp_extract(F.to_json(F.struct("own")), r'(?s)^\{"own":(.*)\}$', 1)
    rows = rows.withColumn("content", F.concat(F.repeat(F.lit('[{"type": "text", "text": "head"}, {"content": '), n), quoted, F.repeat(F.lit("}]"), n)))
    out = contents.texts(rows, "id", "content")
    return out.select("id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


CONTENT_ROWS = [(0, "plain"), (1, "T"), (2, "O"), (3, "a\nb\nc\nd"), (4, ""), (5, "deep"), (6, "x\ny"), (7, "four deep")]


def completion_envelopes(spark, sf_dir):
    """Constant fields around a conversation's last assistant text, as JSON; the id comes from the row, so reruns agree."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("content"))
    message = F.struct(F.lit("assistant").alias("role"), F.col("content").alias("content"))
    body = F.to_json(F.struct(F.concat(F.lit("chatcmpl_"), F.col("conv_id").cast("string")).alias("id"), F.lit("chat.completion").alias("object"), F.array(F.struct(F.lit(0).alias("index"), message.alias("message"), F.lit("stop").alias("finish_reason"))).alias("choices")))
    return rows.select("conv_id", F.get_json_object(body, "$.id").alias("id"), F.length(F.get_json_object(body, "$.choices[0].message.content")).alias("n_chars"), F.get_json_object(body, "$.choices[0].finish_reason").alias("finish_reason"))


def failure_records(spark, sf_dir):
    """Pages as extractions that failed: those that block readers by what they say, others by a status (403, 500, 200, none in turn)."""
    k = F.col("page_id") % 4
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html", F.when(k == 0, 403).when(k == 1, 500).when(k == 2, 200).alias("status"))
    r = reports.failure_record(F.col("status"), F.col("html"))
    return rows.select("page_id", r["success"].alias("success"), F.length(r["text"]).alias("n_chars"), r["error_code"].alias("error_code"), F.coalesce(r["http_status"], F.lit(-1)).alias("http_status"))


def provider_fallbacks(spark, sf_dir):
    """The local model as fallback of providers that are neither native nor local."""
    providers = frame(spark, [(p,) for p, *_ in dims.PROVIDERS], "provider string")
    return providers.withColumn("fallback", models.fallback(F.col("provider"))).where("fallback is not null")


def configured_providers(spark, sf_dir):
    keys = frame(spark, [("OPENAI_API_KEY",), ("XAI_API_KEY",), ("UNKNOWN",)], "key string")
    return catalogues.configured(frame(spark, [(p, k) for p, _, _, k in dims.PROVIDERS], "provider string, key string"), keys)


def configured_segments(spark, sf_dir):
    """The same over tables: nations are the keys that are set, suppliers' nations the providers' keys, those of the first five need none."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("provider"), F.when(F.col("s_nationkey") >= 5, F.col("s_nationkey")).alias("key"))
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("key"))
    return catalogues.configured(suppliers, nations).withColumnRenamed("provider", "s_suppkey")


CACHE = [("openai", "m1", 0), ("openai", "m2", 0), ("groq", "g1", 5000), ("gemini", "x", 3599)]
FETCHED = [("groq", "g9")]


def cached_catalogue(spark, sf_dir):
    return catalogues.refreshed(frame(spark, CACHE, "provider string, model string, at int"), frame(spark, FETCHED, "provider string, model string"), F.lit(3600))


def cached_parts(spark, sf_dir):
    """The same over tables: parts by brand as a cache as old as their size says, larger ones of some brands fetched anew."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    cache = parts.select(F.col("p_brand").alias("provider"), F.col("p_partkey").alias("model"), (F.col("p_size") * 100).alias("at"))
    fetched = parts.where("p_partkey % 50 = 7").select(F.col("p_brand").alias("provider"), (-F.col("p_partkey")).alias("model"))
    return catalogues.refreshed(cache, fetched, F.lit(8000)).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("model").alias("total"))


def model_search(spark, sf_dir):
    rows = frame(spark, [("gpt-4o", "GPT 4o (Free)"), ("o1-mini", None), ("claude", "Claude")], "id string, label string")
    return rows.where(models.found(F.lit(" O1 "), F.col("id"), F.col("label"))).select("id")


def part_search(spark, sf_dir):
    """The same over a table: parts as models, their names as labels (none for every third)."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("label"))
    return rows.where(models.found(F.lit(" bRAND#1"), F.col("p_brand"), F.col("label"))).select("p_partkey")


EFFORTS = [(0, "openai", "gpt-5", "high"), (1, "openai", "o3", "xhigh"), (2, "openai", "davinci", "low"), (3, "groq", "gpt-x", "low"), (4, "openai", "Codex-1", None)]


def reasoning_effort(spark, sf_dir):
    rows = frame(spark, EFFORTS, "i int, provider string, model string, effort string")
    return rows.select("i", models.takes_effort(F.col("provider"), F.col("model")).alias("shown"), F.coalesce(models.passed_effort(F.col("provider"), F.col("effort")), F.lit("")).alias("passed"))


def debug_flags(spark, sf_dir):
    rows = frame(spark, [(0, " Release "), (1, "DEV"), (2, "true"), (3, "production")], "i int, v string")
    return rows.select("i", models.debug_setting(F.col("v")).alias("debug"))


def provider_model_split(spark, sf_dir):
    rows = frame(spark, [(0, "groq/openai/x"), (1, "plain"), (2, None), (3, "/m"), (4, "p/")], "i int, llm string").withColumn("r", models.split_llm(F.col("llm")))
    return rows.select("i", "r.provider", "r.model")


def url_provider_split(spark, sf_dir):
    """The same over a table: pages' URLs without their scheme are provider and model."""
    r = models.split_llm(F.regexp_replace("url", "^https?://", ""))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", r["provider"].alias("provider"), F.length(r["model"]).alias("n_chars"))


def container_urls(spark, sf_dir):
    """Loopback hosts become the container host; others stay."""
    rows = frame(spark, [(0, "http://localhost:8080/s"), (1, "http://[::1]/x"), (2, "https://search.example/q"), (3, "http://0.0.0.0")], "i int, u string")
    return rows.select("i", urls.container_url(F.col("u")).alias("url"))


def container_pages(spark, sf_dir):
    """The same over a table: every other page's host is the machine itself, with a port for some."""
    own = F.concat(F.lit("http://localhost"), F.when(F.col("page_id") % 4 == 0, ":8080").otherwise(""), F.regexp_replace("url", "^https?://[^/]*", ""))
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.when(F.col("page_id") % 2 == 0, own).otherwise(F.col("url")).alias("url"))
    return rows.select("page_id", urls.container_url(F.col("url")).alias("url"))


def models_sorted(spark, sf_dir):
    """Part types as models: their rank by id within their brand, as lists show them."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("provider"), F.concat_ws("/", "p_type", F.format_string("%09d", "p_partkey")).alias("id"))
    return catalogues.in_order(rows)


def _v(rows, columns):
    return f"select * from {dims.values_sql(rows, columns)}"


_ITEM_LINE = f"'[' || coalesce({LABEL_CASE.replace('bias', '(feed_pos - 4)', 1)}, 'Unknown') || '] ' || title || chr(10) || '   Date: ' || coalesce(strftime(published, '%Y-%m-%d'), 'Unknown') || chr(10) || '   URL: ' || url || chr(10)"
_SOURCE_BLOCK = f"'Source ' || rn || ':' || chr(10) || 'Domain: ' || outlet || chr(10) || 'Bias: ' || case when bias is null then 'Unknown' else bias || ' (' || ({LABEL_CASE}) || ') via dataset' end || chr(10) || 'Text Excerpt:' || chr(10) || left(text, 2000) || chr(10) || '{'-' * 40}'"

QUERIES = {
    "feed_list_text": (feed_list_text, f"""with n as (select *, row_number() over (partition by feed_pos order by item_pos) as rn, count(*) over (partition by feed_pos) as n from {ITEMS} i),
        t as (select feed_pos, 'Found ' || any_value(n) || ' news items:' || chr(10) || chr(10) || string_agg(rn || '. ' || {_ITEM_LINE}, chr(10) order by rn) as text from n where rn <= 20 group by feed_pos)
        select feed_pos, length(text)::integer as n_chars, md5(text) as text_md5 from t"""),
    "source_context_text": (source_context_text, f"""with n as (select *, row_number() over (partition by story_id order by pos) as rn from {ARTICLES} a),
        t as (select story_id, string_agg({_SOURCE_BLOCK}, chr(10) || chr(10) order by rn) as text from n where rn <= 5 group by story_id) select story_id, length(text)::integer as n_chars, md5(text) as text_md5 from t"""),
    "keyword_bars": (keyword_bars, _v([(0, " 1. economy" + " " * 23 + " " + "█" * 9), (1, " 2. a rather long keyword that overflows ███"), (2, " 3. x" + " " * 29 + " ")], "i, line")),
    "nested_contents": (nested_contents, """with c as (select conv_id || '-' || turn as id, rtrim(repeat('head' || chr(10), turn::integer), case when coalesce(text, '') = '' then chr(10) else '' end) || coalesce(text, '') as t from conversations)
        select id, length(t)::integer as n_chars, md5(t) as text_md5 from c"""),
    "message_contents": (message_contents, _v(CONTENT_ROWS, "i, content")),
    "completion_envelopes": (completion_envelopes, "select conv_id, 'chatcmpl_' || conv_id as id, length(arg_max(text, turn))::integer as n_chars, 'stop' as finish_reason from conversations where role = 'assistant' group by conv_id"),
    "failure_records": (failure_records, """select page_id, false as success, 0 as n_chars, case when page_id % 4 = 0 or contains(lower(html), 'captcha') then 'blocked_challenge' when page_id % 4 = 1 then 'exception' else 'parse_failure' end as error_code,
        case page_id % 4 when 0 then 403 when 1 then 500 when 2 then 200 else -1 end as http_status from pages"""),
    "provider_fallbacks": (provider_fallbacks, _v([(p, "lm_studio/phi-4") for p, *_ in dims.PROVIDERS if p not in [*models.NATIVE_PROVIDERS, "lmstudio"]], "provider, fallback")),
    "configured_providers": (configured_providers, _v([("openai",), ("grok",), ("ollama",)], "provider")),
    "cached_catalogue": (cached_catalogue, _v([("openai", "m1", "stale"), ("openai", "m2", "stale"), ("groq", "g1", "cached"), ("gemini", "x", "cached")], "provider, model, state")),
    "model_search": (model_search, _v([("o1-mini",)], "id")),
    "reasoning_effort": (reasoning_effort, _v([(0, True, "high"), (1, True, ""), (2, False, "low"), (3, False, ""), (4, True, "")], "i, shown, passed")),
    "debug_flags": (debug_flags, _v([(0, "false"), (1, "true"), (2, "true"), (3, "false")], "i, debug")),
    "provider_model_split": (provider_model_split, _v([(0, "groq", "openai/x"), (1, "unknown", "plain"), (2, "unknown", "unknown"), (3, "unknown", "m"), (4, "p", "unknown")], "i, provider, model")),
    "container_urls": (container_urls, _v([(0, "http://host.docker.internal:8080/s"), (1, "http://host.docker.internal/x"), (2, "https://search.example/q"), (3, "http://host.docker.internal")], "i, url")),
    "models_sorted": (models_sorted, "select p_brand as provider, p_type || '/' || lpad(p_partkey::varchar, 9, '0') as id, row_number() over (partition by p_brand order by p_type || '/' || lpad(p_partkey::varchar, 9, '0'))::integer as rank from part"),
    "configured_segments": (configured_segments, "select s_suppkey from supplier where s_nationkey < 5 or s_nationkey in (select n_nationkey from nation where n_regionkey <> 2)"),
    "cached_parts": (cached_parts, """with c as (select p_brand as b, p_partkey as m, 8000 - p_size * 100 < 3600 as fresh from part), live as (select distinct b from c where fresh),
        f as (select p_brand as b, -p_partkey as m from part where p_partkey % 50 = 7 and p_brand not in (select b from live)),
        u as (select m, 'fetched' as state from f union all select m, case when fresh then 'cached' else 'stale' end from c where b not in (select b from f))
        select state, count(*) as n, sum(m)::bigint as total from u group by state"""),
    "part_search": (part_search, "select p_partkey from part where contains(lower(case when p_partkey % 3 <> 0 then p_name else p_brand end), 'brand#1') or contains(lower(p_brand), 'brand#1')"),
    "url_provider_split": (url_provider_split, """with u as (select page_id, regexp_replace(url, '^https?://', '') as x from pages)
        select page_id, case when contains(x, '/') then coalesce(nullif(split_part(x, '/', 1), ''), 'unknown') else 'unknown' end as provider,
          length(case when contains(x, '/') then coalesce(nullif(x[strpos(x, '/') + 1:], ''), 'unknown') else coalesce(nullif(x, ''), 'unknown') end)::integer as n_chars from u"""),
    "container_pages": (container_pages, """select page_id, case when page_id % 2 = 0 then 'http://host.docker.internal' || case when page_id % 4 = 0 then ':8080' else '' end || regexp_replace(url, '^https?://[^/]*', '') else url end as url from pages"""),
}
