"""Article extraction over the pages table: main text, and title, author and date as pages state them."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswire.catalog.feeds import PAGE_ENTITIES, TITLE, pages
from presswire.dims import literal
from presswire.functions import html, urls

# Ways in which a page states its author (AUTHOR, the label of its host) and date (DATE): by page_id, with neither in the last.
HEADS = [
    '<meta name="author" content="By AUTHOR"><meta property="article:published_time" content="DATET08:30:00Z">',
    "<meta content='AUTHOR' property='article:author'><meta itemprop=datePublished content=DATE>",
    '<script type="application/ld+json">{"@type": "NewsArticle", "author": {"name": "AUTHOR"}, "datePublished": "DATET10:00:00+01:00"}</script>',
    '<script type="application/ld+json">{"@graph": [{"@type": "Person"}, {"author": {"@type": "Person", "name": "AUTHOR"}, "datePublished": "DATE"}]}</script>',
    '<meta name="author" content="https://example.com/people"><meta name="date" content="yesterday"><script type="application/ld+json">[{"author": [{"name": "AUTHOR"}], "datePublished": "DATE"}]</script>',
    "",
]
DAY = "2026-01-01"


def article_main_text(spark, sf_dir):
    """Pages wrapped in what sites wrap them in: an outer division, a sidebar that nests and a related list before the footer."""
    framed = F.regexp_replace(F.regexp_replace("html", "<body>", '<body><div class="page"><div id="left-sidebar"><div><p>Most read this week in all of our sections, with every one of the many long titles.</p></div></div>'), "<footer>", '</div><footer>')
    text = html.main_text(framed)
    return pages(spark, sf_dir).select("page_id", F.size(F.split(text, "\n")).alias("n_blocks"), F.length(text).alias("n_chars"), F.md5(text).alias("text_md5"))


def article_metadata(spark, sf_dir):
    rows = pages(spark, sf_dir)
    form = F.pmod("page_id", F.lit(len(HEADS))).cast("int")
    label = F.initcap(F.regexp_extract(urls.domain(F.col("url")), r"^([^.:]*)", 1))
    date = F.date_format(F.date_add(F.lit(DAY).cast("date"), F.pmod("page_id", F.lit(300)).cast("int")), "yyyy-MM-dd")
    head = F.replace(F.replace(F.element_at(F.array(*map(F.lit, HEADS)), form + 1), F.lit("AUTHOR"), label), F.lit("DATE"), date)
    page = F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), head))
    address = F.when(form == len(HEADS) - 1, F.concat(F.lit("https://news.example/"), F.replace(date, F.lit("-"), F.lit("/")), F.lit("/story"))).otherwise(F.col("url"))
    said = rows.select("page_id", html.metadata(page, address).alias("m"))
    return said.select("page_id", "m.title", "m.author", F.date_format("m.published", "yyyy-MM-dd").alias("date"))


_ANY = lambda names: "|".join(names)
_DECODED = lambda x: "".join("regexp_replace(" for _ in PAGE_ENTITIES) + x + "".join(f", '&{n};?', {literal(c)}, 'g')" for n, c in PAGE_ENTITIES)
_BARE = lambda x: f"regexp_replace({x}, '[\\x02\\x03\\s\\xA0]+', '', 'g')"
#: Depth by a running sum; a token is in a region if some opener's depth holds from there on; blocks by a running count of breaks.
MAIN_TEXT = f"""
  with h as (select page_id, regexp_replace(regexp_replace(replace(replace(html, '<body>', '<body><div class="page"><div id="left-sidebar"><div><p>Most read this week in all of our sections, with every one of the many long titles.</p></div></div>'), '<footer>', '</div><footer>'),
      '(?s)<!--.*?-->', ' ', 'g'), '(?is)<head\\b.*?</head>|<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g') as html from pages),
  k as (select page_id, regexp_extract_all(html, '<[A-Za-z/!?][^>]*>|[^<]+|<') as ts from h),
  t as (select page_id, unnest(ts) as t, unnest(range(len(ts))) as i from k),
  e as (select *, regexp_matches(t, '(?i)^<({_ANY(html.CONTAINERS)})\\b') as opens, regexp_matches(t, '(?i)^</({_ANY(html.CONTAINERS)})\\s*>') as closes,
      regexp_matches(t, '(?i)^<({_ANY(html.SKIPPED)})\\b') or regexp_matches(t, '^<div (class="ad"|id="left-sidebar")') as skips, regexp_matches(t, '(?i)^<(article|main)\\b') as inside from t),
  d as (select *, sum(opens::integer - closes::integer) over (partition by page_id order by i) as depth from e),
  r as (select a.page_id, a.i, any_value(a.t) as t,
      coalesce(bool_or(o.skips and (select min(m.depth) from d m where m.page_id = a.page_id and m.i between o.i and a.i) >= o.depth), false) as out,
      coalesce(bool_or(o.inside and (select min(m.depth) from d m where m.page_id = a.page_id and m.i between o.i and a.i) >= o.depth), false) as own
    from d a left join d o on o.page_id = a.page_id and o.i <= a.i and o.opens and (o.skips or o.inside) group by a.page_id, a.i),
  q as (select *, not regexp_matches(t, '^<[A-Za-z/!?]') as words, regexp_matches(t, '(?i)^</?({_ANY(html.BLOCKS)})\\b') as breaks from r),
  p as (select *, case when words then t when breaks then chr(1) when regexp_matches(t, '(?i)^<a\\b') then chr(2) when regexp_matches(t, '(?i)^</a\\b') then chr(3) else '' end as piece from q),
  c as (select page_id, string_agg(case when own and not out then piece else chr(1) end, '' order by i) as mine, string_agg(case when not out then piece else chr(1) end, '' order by i) as whole from p group by page_id),
  m as (select page_id, unnest(string_split(s, chr(1))) as part, unnest(range(len(string_split(s, chr(1))))) as i from (select page_id, case when length(regexp_replace(mine, '[\\x01-\\x03\\s]+', '', 'g')) >= 200 then mine else whole end as s from c)),
  b as (select page_id, i, trim(regexp_replace({_DECODED("translate(part, chr(2) || chr(3), '')")}, '[\\s\\xA0]+', ' ', 'g')) as text, length({_BARE("array_to_string(regexp_extract_all(part, '\\x02([^\\x02\\x03]*)', 1), '')")})::double / greatest(length({_BARE("part")}), 1) as linked from m),
  n as (select *, len(string_split(text, ' ')) as n from b where text <> ''),
  g as (select *, n >= 15 and linked <= 1 / 3 as good from n),
  f as (select *, coalesce(lag(good) over w, false) or coalesce(lead(good) over w, false) as near from g window w as (partition by page_id order by i)),
  o as (select page_id, count(*)::integer as n_blocks, string_agg(text, chr(10) order by i) as x from f where good or (n >= 3 and linked <= 1 / 3 and near) group by page_id)
  select page_id, n_blocks, length(x)::integer as n_chars, md5(x) as text_md5 from pages left join o using (page_id)"""
_LABEL = "(select string_agg(upper(x[1]) || lower(x[2:]), ' ') from (select unnest(string_split(regexp_extract(replace(regexp_extract(url, '^\\s*(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1), 'www.', ''), '^([^.:]*)', 1), ' ')) as x))"

QUERIES = {
    "article_main_text": (article_main_text, MAIN_TEXT),
    "article_metadata": (article_metadata, f"""select page_id, nullif({TITLE}, '') as title, case when page_id % {len(HEADS)} < {len(HEADS) - 1} then {_LABEL} end as author,
        strftime(date '{DAY}' + (page_id % 300)::integer, '%Y-%m-%d') as date from pages"""),
}
