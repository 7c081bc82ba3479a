"""Queries over literal fixtures: what the driver tables do not hold. Expected rows are stated as SQL values or recomputed in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswire import dims
from presswire.functions import models, rating, reports, text, urls
from presswire.operators import joins
from presswire.sources import catalogues, profiles, sinks, videos


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


SECRETS = [
    (0, "Authorization: Bearer abc.def-123"), (1, "api_key=s3cret, next"), (2, "refresh_token: zzz; access-token = yyy"), (3, "cookie: a=b; c=d"), (4, "use sk-abcdefgh1234 now"),
    (5, "jwt aaaaaaaaaaaaaaaaaaaaaa.bbbbbbbbbbbbbbbbbbbbbb.cccccccccccccccccccccc end"), (6, "nothing here"),
]


def redact_secrets(spark, sf_dir):
    return frame(spark, SECRETS, "i int, message string").select("i", text.redact(F.col("message")).alias("redacted"))


def _redact_sql(column: str) -> str:
    for pattern, keep in text.SECRETS:
        column = f"regexp_replace({column}, {dims.literal(pattern)}, '{chr(92) + '1' if keep else ''}[REDACTED]', 'g')"
    return column


DOMAINS = [(0, "reuters.com"), (1, "https://www.cnn.com/a?b"), (2, "WWW.FoxNews.com"), (3, " reason.com "), (4, "httpbin.org"), (5, "nobody.example"), (6, "http://taibbi.substack.com/p/x")]


def rated_domain_lookup(spark, sf_dir):
    rows = frame(spark, DOMAINS, "i int, input string").withColumn("domain", urls.classifier_domain(F.col("input")))
    out = joins.rate_domains(rows, "domain")
    return out.select("i", "domain", "bias", "bias_label", "confidence", "method", F.coalesce("factual", F.lit("")).alias("factual"), F.coalesce(rating.interpretation(F.col("bias"), F.col("category")), F.lit("")).alias("interpretation"))


DOMAIN_ROWS = [
    (0, "reuters.com", 0, "Center", 1, "dataset", "high", "balanced"), (1, "cnn.com", -2, "Lean Left", 1, "dataset", "mixed", ""), (2, "www.foxnews.com", 3, "Right", 1, "dataset", "mixed", "right"),
    (3, "reason.com", 0, "Center", 1, "dataset", "mostly_factual", "libertarian"), (4, "", 0, "Unknown", 0, "unknown", "", "balanced"), (5, "nobody.example", 0, "Unknown", 0, "unknown", "", "balanced"),
    (6, "taibbi.substack.com", 0, "Center", 1, "dataset", "mostly_factual", "balanced"),
]

LEXICON = [
    (0, "Progressive voices on social justice, inequality and systemic harm"), (1, "freedom freedom freedom"), (2, "Freedom, liberty, the constitution and every patriot"), (3, "progressive social justice inequality"),
    (4, "libertarian and freedom; civil liberties"), (5, "progressive, inequality, systemic; freedom"), (6, "traditional patriot liberty"), (7, ""),
]


def lexicon_texts(spark, sf_dir):
    t = F.col("t")
    three = text.score_three_sided(t)
    return frame(spark, LEXICON, "i int, t string").select("i", text.score_two_sided(t).alias("two_sided"), three["bias"].alias("three_sided"), F.coalesce(three["category"], F.lit("")).alias("category"))


LEXICON_ROWS = [(0, -2, -2, ""), (1, 0, 0, ""), (2, 2, 2, ""), (3, -2, 0, ""), (4, 0, 0, "libertarian"), (5, 0, 0, ""), (6, 2, 0, ""), (7, 0, 0, "")]

SITE = [
    (0, '<a href="/news-source/x">s</a> <a href="/media-bias/reuters?y">m</a> AllSides Media Bias Rating: <b>Lean Left</b>'), (1, "bias rating: Not Rated, but left"), (2, "we are lean left people"), (3, "far right fringe"),
    (4, "nothing"), (5, '<a href="/news-source/only">z</a> Bias  Rating - Far Left'), (6, "mixed signals"),
]


def allsides_label(spark, sf_dir):
    h = F.col("h")
    name = rating.site_label(h)
    return frame(spark, SITE, "i int, h string").select("i", F.coalesce(rating.detail_path(h), F.lit("")).alias("path"), F.coalesce(name, F.lit("")).alias("label"), F.coalesce(rating.site_score(name), F.lit(99)).alias("score"))


SITE_ROWS = [(0, "/news-source/x", "lean left", -2), (1, "", "", 99), (2, "", "left", -3), (3, "", "right", 3), (4, "", "", 99), (5, "/news-source/only", "far left", -4), (6, "", "mixed", 0)]

REPLIES = [(0, '```json\n{"bias": 2, "confidence": 0.8}\n```'), (1, '{"bias": 9, "confidence": 1.7}'), (2, '{"note": "x"}'), (3, "no object"), (4, '{"bias": -7}'), (5, "{broken]}")]


def llm_json_bias(spark, sf_dir):
    a = rating.model_answer(F.col("r"))
    return frame(spark, REPLIES, "i int, r string").select("i", F.coalesce(a["bias"], F.lit(99)).alias("bias"), F.coalesce(a["confidence"], F.lit(-1.0)).alias("confidence"))


REPORT = """# Report
## 2. Source Matrix
| Outlet | Bias | Link |
|---|:---:|---|
| A, Inc | -2 | [a](https://a.example/one) |
| B "quoted" | 2 | [b](https://b.example/two/) |
## Notes
[^1]: see https://a.example/one/).
[^2]: see https://c.example/three;
"""
REPORTS = [
    (0, REPORT, ["https://a.example/one", "https://b.example/two"]),
    (1, REPORT, ["https://a.example/one"]),
    (2, "# Report\nno matrix", ["https://a.example/one"]),
    (3, REPORT.replace("[^2]: see https://c.example/three;\n", ""), ["https://A.example/one/", "https://b.example/two"]),
    (4, REPORT.replace("## 2. Source Matrix", "# Source Matrix"), ["https://a.example/one", "https://b.example/two"]),
]


def report_rows(spark):
    return frame(spark, REPORTS, "i int, r string, allowed array<string>")


def report_matrix_urls(spark, sf_dir):
    r = F.col("r")
    return report_rows(spark).select("i", F.array_join(reports.matrix_urls(r), " ").alias("matrix"), F.array_join(reports.footnote_urls(r), " ").alias("footnotes"))


_AB = "https://a.example/one https://b.example/two/"
MATRIX_ROWS = [(0, _AB, "https://a.example/one/ https://c.example/three"), (1, _AB, "https://a.example/one/ https://c.example/three"), (2, "", ""), (3, _AB, "https://a.example/one/"), (4, _AB, "https://a.example/one/ https://c.example/three")]


def report_validation(spark, sf_dir):
    return report_rows(spark).select("i", F.coalesce(reports.report_error(F.col("r"), F.col("allowed")), F.lit("")).alias("error"))


VALIDATION_ROWS = [(0, "footnotes outside matrix: https://c.example/three"), (1, "unknown sources: https://b.example/two/"), (2, "missing source matrix"), (3, ""), (4, "footnotes outside matrix: https://c.example/three")]


def report_matrix_csv(spark, sf_dir):
    return report_rows(spark).select("i", F.coalesce(sinks.matrix_csv(F.col("r")), F.lit("")).alias("csv"))


_CSV = 'Outlet,Bias,Link\r\n"A, Inc",-2,[a](https://a.example/one)\r\n"B ""quoted""",2,[b](https://b.example/two/)'
CSV_ROWS = [(0, ""), (1, ""), (2, ""), (3, ""), (4, _CSV)]

PROFILES = [
    (0, "# My Channel\n\nintro\n\n## About us\nWe read news.\nAll of it.\n\n## Worldview\nA libertarian and liberal view\n\n## Topics\n- Economy\n* Law\nnot a bullet\n• Peace\n"),
    (1, "channel:\n  name: X\n"), (2, '{"name": "Flat", "topics": ["a", "b"]}'), (3, '{"channel": {"name": "Nested"}, "topics": ["c"]}'), (4, "Plain name\n\nfirst line\nsecond line"), (5, "[1, 2]"), (6, "#: odd"), (7, ""),
]


def profile_format_detect(spark, sf_dir):
    return frame(spark, PROFILES, "i int, c string").select("i", reports.detect_format(F.col("c")).alias("format"))


def profile_markdown_sections(spark, sf_dir):
    out = profiles.from_markdown(frame(spark, PROFILES[:1], "id int, content string"))
    return out.select("id", "name", "description", "worldview", F.array_join("topics", "|").alias("topics"))


def profile_json(spark, sf_dir):
    return profiles.from_json(frame(spark, PROFILES[2:4], "id int, content string")).select("id", "name", F.array_join("topics", "|").alias("topics"))


def profile_text(spark, sf_dir):
    return profiles.from_text(frame(spark, PROFILES[4:5], "id int, content string"))


YOUTUBE = [
    (0, "https://www.youtube.com/watch?v=dQw4w9WgXcQ&t=1"), (1, "https://youtu.be/dQw4w9WgXcQ"), (2, "https://www.youtube.com/embed/abc_DEF-123"), (3, "https://youtube.com/shorts/abcdefghijk"),
    (4, "https://www.youtube.com/watch?t=1&v=dQw4w9WgXcQ"), (5, "https://example.com/"),
]


def youtube_id(spark, sf_dir):
    return frame(spark, YOUTUBE, "i int, u string").select("i", F.coalesce(reports.youtube_id(F.col("u")), F.lit("")).alias("video_id"))


def video_metadata(spark, sf_dir):
    """Output limits: description 2000, 20 tags, English captions of known kinds."""
    info = '{"description": "%s", "tags": [%s], "subtitles": {}, "automatic_captions": {"en": [{"ext": "ttml"}, {"ext": "vtt"}]}}' % ("d" * 2500, ", ".join(f'"t{i}"' for i in range(30)))
    rows = videos.metadata(frame(spark, [(0, info), (1, '{"description": null, "subtitles": {"de": [{"ext": "vtt"}]}}'), (2, "no json")], "i int, json string"))
    return rows.select("i", F.length("description").alias("description_chars"), F.size("tags").alias("n_tags"), "has_captions")


def page_video_metadata(spark, sf_dir):
    """The same over a table: pages as videos, with captions of some."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    tracks = F.create_map(F.when(F.col("page_id") % 2 == 0, "en").otherwise("de"), F.array(F.struct(F.when(F.col("page_id") % 3 == 0, "vtt").otherwise("ttml").alias("ext"))))
    info = F.to_json(F.struct(F.col("url").alias("title"), F.col("html").alias("description"), F.split("html", " ").alias("tags"), tracks.alias("subtitles")))
    rows = videos.metadata(pages.select("page_id", info.alias("json")))
    return rows.select("page_id", "title", F.length("description").alias("description_chars"), F.size("tags").alias("n_tags"), "has_captions")


YAML_PROFILES = [
    (0, 'channel:\n  name: "News desk"  # shown\n  description: |\n    First line\n    second line\n\n  worldview: libertarian\ncontent_style:\n  name: wrong\ntopics:\n  primary:\n    - economy\n    - "rule of law"\n  secondary: [peace, \'trade\']\n  other:\n    - no\ntopic_keywords:\n  economy:\n    - jobs\n'),
    (1, "# flat\nname: Flat\ndescription: one: two\ntopics:\n- a\n- b\n"), (2, "topics: [x]"), (3, "no yaml"),
]
YAML_ROWS = [(0, "News desk", "First line\nsecond line", "libertarian", "economy|rule of law|peace|trade"), (1, "Flat", "one: two", "", "a|b"), (2, "", "", "", "x"), (3, "", "", "", "")]


def profile_yaml(spark, sf_dir):
    out = profiles.from_yaml(frame(spark, YAML_PROFILES, "id int, content string"))
    return out.select("id", "name", "description", "worldview", F.array_join("topics", "|").alias("topics"))


def profile_write_back(spark, sf_dir):
    """Profiles of all kinds written as flat YAML and read again."""
    kinds = [profiles.from_markdown(frame(spark, PROFILES[:1], "id int, content string")), profiles.from_yaml(frame(spark, YAML_PROFILES[:1], "id int, content string").withColumn("id", F.col("id") + 10))]
    out = profiles.from_yaml(profiles.to_yaml(kinds[0].unionByName(kinds[1])))
    return out.select("id", "name", "description", "worldview", F.array_join("topics", "|").alias("topics"))


def context_cards(spark, sf_dir):
    rows = profiles.from_yaml(frame(spark, YAML_PROFILES[:1], "id int, content string")).select("id", "name", "worldview", F.repeat("description", 40).alias("description"), F.flatten(F.array_repeat("topics", 3)).alias("topics"))
    missing = frame(spark, [(9, None, None, None, None)], "id int, name string, worldview string, description string, topics array<string>")
    rows = rows.unionByName(missing)
    card = reports.context_card(F.col("name"), F.col("worldview"), F.col("description"), F.col("topics"))
    return rows.select("id", F.length(card).alias("n_chars"), F.split_part(card, F.lit("\n"), F.lit(2)).alias("second_line"))


_CARD = len("Channel Profile:\n- Name: News desk\n- Worldview: libertarian\n- Description: \n- Topics: \n") + 500 + len(", ".join(["economy", "rule of law", "peace", "trade"] * 2 + ["economy", "rule of law"]))
CARD_ROWS = [(0, _CARD, "- Name: News desk"), (9, len("Channel Profile: Not configured. Using default settings."), "")]

MODELS = [
    ("gemini", "models/gemini-2.0-flash"), ("Gemini ", "gemini/models/models/x"), ("groq", "openai/gpt-oss-120b"), ("xai", "grok/xai/grok-2"), ("lm-studio", "lm_studio/phi-4"), ("openrouter", "openrouter/openrouter/a/b"),
    ("nobody", "nobody/x"), ("openai", None), ("ollama", " ollama/llama3 "),
]
MODEL_ROWS = [
    (0, "gemini", "gemini-2.0-flash", "gemini/gemini-2.0-flash"), (1, "gemini", "x", "gemini/x"), (2, "groq", "openai/gpt-oss-120b", "groq/openai/gpt-oss-120b"), (3, "grok", "grok-2", "xai/grok-2"), (4, "lmstudio", "phi-4", "lm_studio/phi-4"),
    (5, "openrouter", "a/b", "openrouter/a/b"), (6, "nobody", "nobody/x", "openai/nobody/x"), (7, "openai", "", "openai/"), (8, "ollama", "llama3", "ollama/llama3"),
]


def model_normalize(spark, sf_dir):
    rows = frame(spark, [(i, *m) for i, m in enumerate(MODELS)], "i int, p string, m string")
    p, m = F.col("p"), F.col("m")
    return rows.select("i", models.provider_name(p).alias("provider"), models.model_for_provider(p, m).alias("model"), models.call_name(p, m).alias("call_name"))


PRICED = [(0, "A", "openrouter", 0.2, 0.4), (1, "B", "openrouter", 0.0, 0.0), (2, "C", "groq", 1.0, 2.0), (3, "D", "openrouter", 10.0, 0.15003)]


def model_price_label(spark, sf_dir):
    rows = frame(spark, PRICED, "i int, name string, provider string, i_cost double, o_cost double")
    return rows.select("i", models.price_label(F.col("name"), F.col("provider"), F.col("i_cost"), F.col("o_cost")).alias("label"))


CATALOGUES = [
    ("openrouter", '{"data": [{"id": "openrouter/z-ai/m:free", "name": "Z", "pricing": {"prompt": "0", "completion": "0"}, "context_length": 8}, {"id": "b/vision:free", "pricing": {"prompt": "0", "completion": "bad"}}, {"id": "c/paid", "pricing": {"prompt": "0.0000002", "completion": "0.0000004"}}]}'),
    ("openai", '{"data": [{"id": "gpt-b", "name": "B"}, {"name": null}, {"id": "gpt-a"}]}'),
    ("lmstudio", '{"data": [{"id": "lm_studio/phi-4"}]}'),
    ("gemini", '{"data": [{"id": "models/gemini-2.0-flash"}, {"id": ""}]}'),
    ("mistral", "no json"),
    ("ollama", '{"models": [{"name": "llama3"}]}'),
]
CATALOGUE_ROWS = [
    ("openrouter", "z-ai/m:free", "Z", True, 0, 0, 8), ("openrouter", "b/vision:free", "b/vision:free", True, 0, 0, 0), ("openrouter", "c/paid", "c/paid", False, 0.2, 0.4, 0), ("openai", "gpt-b", "B", False, 0, 0, 0),
    ("openai", "gpt-a", "gpt-a", False, 0, 0, 0), ("lmstudio", "phi-4", "lm_studio/phi-4", True, 0, 0, 0), ("gemini", "gemini-2.0-flash", "models/gemini-2.0-flash", False, 0, 0, 0), ("ollama", "llama3", "llama3", True, 0, 0, 0),
]


def model_catalogue(spark, sf_dir):
    out = catalogues.scan_all(frame(spark, CATALOGUES, "provider string, json string"), [p for p, _ in CATALOGUES])
    return out.select("provider", "id", "name", "is_free", F.round("input_cost_per_m", 6).alias("input_cost"), F.round("output_cost_per_m", 6).alias("output_cost"), "context_length")


RECOVERY = [("b", True), ("openrouter/free", True), ("a/vision", True), ("c", False), ("a", False), ("", True), ("b", False)]


def model_recovery_rank(spark, sf_dir):
    tiers = catalogues.recovery_order(frame(spark, RECOVERY, "id string, is_free boolean"))
    return tiers.select("id", "tier")


def model_command_line(spark, sf_dir):
    data = [('{"models": [{"slug": "m-1", "display_name": "M One"}, {"id": "m-2"}, {"display_name": "none"}, {"slug": "", "id": "m-3", "display_name": ""}]}',)]
    return catalogues.command_line(frame(spark, data, "json string")).select("id", "name")


ERRORS = [
    (0, 429, "x", "openai"), (1, None, "RESOURCE_EXHAUSTED", "gemini"), (2, 503, "down", "groq"), (3, None, "quota limit: 0 reached", "gemini"), (4, None, "limit: 05", "gemini"), (5, 400, "too many requests", "openai"),
    (6, None, "NotFoundError: model", "openrouter"), (7, None, "NotFoundError: model", "openai"), (8, None, "internal_server_error", "groq"), (9, None, "fine", "groq"),
]


def error_classes(spark, sf_dir):
    m = F.col("m")
    rows = frame(spark, ERRORS, "i int, s int, m string, p string")
    return rows.select("i", models.router_rate_limited(F.col("s"), m).alias("router"), models.service_rate_limited(m, F.lit("Error")).alias("service"), models.quota_zero(m).alias("quota_zero"), models.model_not_found(F.col("p"), m).alias("not_found"))


ERROR_ROWS = [
    (0, True, False, False, False), (1, True, True, False, False), (2, True, False, False, False), (3, False, False, True, False), (4, False, False, True, False), (5, False, True, False, False),
    (6, False, False, False, True), (7, False, False, False, False), (8, True, False, False, False), (9, False, False, False, False),
]

RETRY = [(0, "retry in 7s"), (1, "Retry in 33s please"), (2, "retry in 12.5s"), (3, "none"), (4, "retry in 900s")]


def backoff_schedule(spark, sf_dir):
    rows = frame(spark, RETRY, "i int, m string").withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(models.RETRIES - 1))))
    return rows.select("i", "attempt", models.backoff(F.col("attempt"), F.col("m")).alias("delay"))


BRIDGES = [
    (0, "http://localhost:8787/v1", ""), (1, "http://127.0.0.1:8787", ""), (2, "http://[::1]:8787/v1", ""), (3, "http://host.docker.internal:8787/v1", ""), (4, "http://<host>:8787", "placeholder"), (5, "http://localhost:port", "bad_port"),
    (6, "https://example.com/v1", "not_local public"), (7, "http://0.0.0.0:8787", "blocked_host not_local public"), (8, "", "missing"), (9, "ftp://localhost/x", "not_http"), (10, "http://localhost:99999", "bad_port"),
]


def bridge_url_errors(spark, sf_dir):
    return frame(spark, [b[:2] for b in BRIDGES], "i int, u string").select("i", F.array_join(urls.bridge_errors(F.col("u")), " ").alias("errors"))


def local_server_urls(spark, sf_dir):
    rows = frame(spark, [(0, "http://localhost:1234"), (1, "http://localhost:1234/v1/"), (2, " http://x/ ")], "i int, u string")
    return rows.select("i", urls.with_v1(F.col("u")).alias("base_url"))


def value_splitting(spark, sf_dir):
    return frame(spark, [(0, "a.com, b.com\n\n c.com ,,"), (1, "")], "i int, s string").select("i", F.array_join(text.split_values(F.col("s")), "|").alias("parts"))


def temperatures(spark, sf_dir):
    rows = frame(spark, [(0, "gpt-5-mini", 0.1, 0.2), (1, "gpt-4", 0.1, 0.2), (2, "gpt-4", None, 0.2), (3, "gpt-4", None, None)], "i int, m string, o double, g double")
    return rows.select("i", models.temperature(F.col("m"), F.col("o"), F.col("g")).alias("temperature"))


def http_statuses(spark, sf_dir):
    kinds = ["source_extraction", "rate_limit", "budget", "not_found", "bad_request", "other"]
    return frame(spark, [(k,) for k in kinds], "kind string").select("kind", models.http_status(F.col("kind")).alias("status"))


def budget_free_models(spark, sf_dir):
    rows = frame(spark, [(0, "openrouter", "x:FREE"), (1, "ollama", "y"), (2, "openai", "z"), (3, "lmstudio", "w")], "i int, p string, m string")
    return rows.select("i", models.is_free(F.col("p"), F.col("m")).alias("free"), models.bridge_model(F.concat(F.lit("openai/"), "m")).alias("bridge_model"))


def _v(rows, columns):
    return f"select * from {dims.values_sql(rows, columns)}"


QUERIES = {
    "redact_secrets": (redact_secrets, f"select i, {_redact_sql('message')} as redacted from {dims.values_sql(SECRETS, 'i, message')}"),
    "rated_domain_lookup": (rated_domain_lookup, f"select i, domain, bias, bias_label, confidence::double as confidence, method, factual, interpretation from {dims.values_sql(DOMAIN_ROWS, 'i, domain, bias, bias_label, confidence, method, factual, interpretation')}"),
    "lexicon_texts": (lexicon_texts, _v(LEXICON_ROWS, "i, two_sided, three_sided, category")),
    "allsides_label": (allsides_label, _v(SITE_ROWS, "i, path, label, score")),
    "llm_json_bias": (llm_json_bias, "select i, bias, confidence::double as confidence from (values (0, 2, 0.8), (1, 4, 1.0), (2, 0, 0.5), (3, 99, -1.0), (4, -4, 0.5), (5, 99, -1.0)) v(i, bias, confidence)"),
    "report_matrix_urls": (report_matrix_urls, _v(MATRIX_ROWS, "i, matrix, footnotes")),
    "report_validation": (report_validation, _v(VALIDATION_ROWS, "i, error")),
    "report_matrix_csv": (report_matrix_csv, _v(CSV_ROWS, "i, csv")),
    "profile_format_detect": (profile_format_detect, _v([(0, "md"), (1, "yaml"), (2, "json"), (3, "json"), (4, "txt"), (5, "json"), (6, "md"), (7, "txt")], "i, format")),
    "profile_markdown_sections": (profile_markdown_sections, _v([(0, "My Channel", "We read news.\nAll of it.", "libertarian", "Economy|Law|Peace")], "id, name, description, worldview, topics")),
    "profile_json": (profile_json, _v([(2, "Flat", "a|b"), (3, "", "c")], "id, name, topics")),
    "profile_text": (profile_text, _v([(4, "Plain name", "first line\nsecond line")], "id, name, description")),
    "youtube_id": (youtube_id, f"select i, coalesce(nullif(regexp_extract(u, '(?:youtube\\.com/watch\\?v=|youtu\\.be/|youtube\\.com/embed/)([a-zA-Z0-9_-]{{11}})', 1), ''), regexp_extract(u, 'youtube\\.com/shorts/([a-zA-Z0-9_-]{{11}})', 1)) as video_id from {dims.values_sql(YOUTUBE, 'i, u')}"),
    "video_metadata": (video_metadata, _v([(0, 2000, 20, True), (1, 0, 0, False), (2, 0, 0, False)], "i, description_chars, n_tags, has_captions")),
    "page_video_metadata": (page_video_metadata, "select page_id, url as title, least(length(html), 2000)::integer as description_chars, least(len(string_split(html, ' ')), 20)::integer as n_tags, page_id % 6 = 0 as has_captions from pages"),
    "profile_yaml": (profile_yaml, _v(YAML_ROWS, "id, name, description, worldview, topics")),
    "profile_write_back": (profile_write_back, _v([(0, "My Channel", "We read news.\nAll of it.", "libertarian", "Economy|Law|Peace"), (10, *YAML_ROWS[0][1:])], "id, name, description, worldview, topics")),
    "context_cards": (context_cards, _v(CARD_ROWS, "id, n_chars, second_line")),
    "model_normalize": (model_normalize, _v(MODEL_ROWS, "i, provider, model, call_name")),
    "model_price_label": (model_price_label, _v([(0, "A ($0.2/$0.4 per 1M)"), (1, "B (Free)"), (2, "C"), (3, "D ($10/$0.15 per 1M)")], "i, label")),
    "model_catalogue": (model_catalogue, f"select provider, id, name, is_free, input_cost::double as input_cost, output_cost::double as output_cost, context_length::bigint as context_length from {dims.values_sql(CATALOGUE_ROWS, 'provider, id, name, is_free, input_cost, output_cost, context_length')}"),
    "model_recovery_rank": (model_recovery_rank, f"select id, min(case when id = 'openrouter/free' then 0 when is_free and not regexp_matches(lower(id), '{'|'.join(models.NOT_TEXT)}') then 1 when is_free then 2 else 3 end)::integer as tier from {dims.values_sql(RECOVERY, 'id, is_free')} where id <> '' group by id"),
    "model_command_line": (model_command_line, _v([("m-1", "M One"), ("m-2", "m-2"), ("m-3", "m-3")], "id, name")),
    "error_classes": (error_classes, _v(ERROR_ROWS, "i, router, service, quota_zero, not_found")),
    "backoff_schedule": (backoff_schedule, f"select i, a::integer as attempt, least(greatest(5 * pow(2, a), coalesce(nullif(regexp_extract(m, '(?i)retry in ([0-9]+)s', 1), '')::double, 0)), 120)::double as delay from {dims.values_sql(RETRY, 'i, m')} cross join range(5) r(a)"),
    "bridge_url_errors": (bridge_url_errors, _v([(b[0], b[2]) for b in BRIDGES], "i, errors")),
    "local_server_urls": (local_server_urls, _v([(0, "http://localhost:1234/v1"), (1, "http://localhost:1234/v1"), (2, "http://x/v1")], "i, base_url")),
    "value_splitting": (value_splitting, _v([(0, "a.com|b.com|c.com"), (1, "")], "i, parts")),
    "temperatures": (temperatures, "select i, t::double as temperature from (values (0, 1.0), (1, 0.1), (2, 0.2), (3, 0.7)) v(i, t)"),
    "http_statuses": (http_statuses, _v([("source_extraction", 422), ("rate_limit", 429), ("budget", 402), ("not_found", 404), ("bad_request", 400), ("other", 500)], "kind, status")),
    "budget_free_models": (budget_free_models, _v([(0, True, "x:FREE"), (1, True, "y"), (2, False, "z"), (3, True, "w")], "i, free, bridge_model")),
}
