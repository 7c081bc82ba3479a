"""Column functions against plain Python on random input."""

import html
import re
from urllib.parse import urlparse

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from presswire.functions import models, text, urls

RELAXED = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
PARTS = st.tuples(
    st.sampled_from(["http", "HTTPS", "ftp"]), st.sampled_from(["Example.com", "www.a.b", "u:p@h.org:80", "www.www.x"]), st.lists(st.text("abAB9-;_", max_size=5), max_size=4), st.sampled_from(["", "?q=1", "#f", "?a#b"])
)
URLS = st.lists(PARTS.map(lambda p: f"{p[0]}://{p[1]}/{'/'.join(p[2])}{p[3]}"), min_size=5, max_size=30)


def one(spark, values, column, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(column(F.col("v"))).collect()]


@RELAXED
@given(URLS)
def test_urls(spark, values):
    parsed = [urlparse(v) for v in values]
    assert one(spark, values, urls.normalize) == [f"{p.scheme.lower()}://{p.netloc.lower()}{p.path.rstrip('/')}" for p in parsed]
    assert one(spark, values, urls.domain) == [p.netloc.replace("www.", "") for p in parsed]


@RELAXED
@given(URLS)
def test_slugs(spark, values):
    def slug(v):
        parts = [p for p in urlparse(v).path.split("/") if p]
        words = re.split(r"[^a-zA-Z0-9]+", "-".join(parts[-2:]).lower()) if parts else []
        return [w for w in words if w and w not in urls.SLUG_STOP][:6]

    assert one(spark, values, urls.slug_keywords) == [slug(v) for v in values]


@RELAXED
@given(st.lists(st.text("ab CD.,19\n", max_size=40), min_size=1, max_size=20))
def test_tokens_and_counts(spark, values):
    want = [{t for t in re.findall(r"[a-z0-9]{3,}", v.lower()) if t not in text.TOKEN_STOP} for v in values]
    assert [set(x) for x in one(spark, values, text.tokens)] == want
    assert one(spark, values, lambda c: text.count_of(c, F.lit("ab"))) == [v.count("ab") for v in values]


def test_summary_is_unescaped(spark):
    values = ["<p>a&amp;b</p>  c &quot;d&quot;", "&lt;x&gt; &#39;y", "", "a\n\tb"]
    want = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", v))).strip() for v in values]
    assert one(spark, values, text.clean_summary) == want


def test_entities_match_python(spark):
    values = [
        "It&rsquo;s &mdash; &#8220;q&#x201D; &#X2014 &hellip;", "&notit; &amp &ampx &copy=1 &eacute;&Eacute; &apos;", "&unknown; &am & &; &#; &#x; &#zz;", "&#0; &#128; &#x80; &#xD800; &#1114112; &#99999999999; &#x1F600; &#00000000065;",
        "&#1;&#127;x", "no entity", "", "&nbsp;&lt", "a&frac12b &times;&divide;", "&#10;line", "&amp;amp;",
    ]
    assert one(spark, values, text.unescape) == [html.unescape(v) for v in values]


def test_dates_of_feeds(spark):
    from presswire.sources import feeds

    values = [
        "Wed, 04 Feb 2026 10:00:00 +0000", "4 Feb 2026 10:00 GMT", "Wed, 04 Feb 26 10:00:00 +0100", "2026-02-04T10:00:00Z", "2026-02-04T10:00:00.5+00:00", "2026-02-04T10:00:00.123456789Z", "2026-02-04T10:00Z", "2026-02-04T11:00:00+0100",
        "2026-02-04T10:00:00", "2026-02-04 10:00", "Wednesday, 04 Feb 2026 10:00:00 EST", "2026-02-04", "soon", "",
    ]
    at = 1770199200
    want = [at, at, at - 3600, at, at, at, at, at, at, at, at + 5 * 3600, at - 10 * 3600, None, None]
    assert one(spark, values, lambda c: F.unix_seconds(feeds.timestamp(c))) == want


def test_redaction_matches_python(spark):
    values = ["Authorization: Bearer abc", "x api-key: k, y", "sk-12345678 sk-short", "Cookie: a=b; c", "plain"]

    def redact(v):
        for pattern, keep in text.SECRETS:
            v = re.sub(pattern, r"\1[REDACTED]" if keep else "[REDACTED]", v)
        return v

    assert one(spark, values, text.redact) == [redact(v) for v in values]


def test_backoff_reads_whole_seconds_only(spark):
    rows = spark.createDataFrame([(0, "retry in 7s"), (0, "retry in 7.5s"), (4, "x"), (0, "retry in 500s")], "k int, m string")
    assert [r[0] for r in rows.select(models.backoff(F.col("k"), F.col("m"))).collect()] == [7.0, 5.0, 80.0, 120.0]
