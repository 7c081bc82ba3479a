"""Web pages: a tag tokenizer with running depth, block scores, and what pages say of themselves (title, author, date). Native columns, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswire.functions import text as T

# Tags that nest and are closed by hand: their depth is counted. Tags that may stay open (p, li, td) do not count.
CONTAINERS = ["div", "section", "article", "main", "nav", "aside", "header", "footer", "form", "ul", "ol", "dl", "table", "figure", "menu", "select", "button", "dialog"]
# Containers that hold no article text; headers may, when they stand in an article.
SKIPPED = ["nav", "aside", "footer", "form", "table", "menu", "select", "button", "dialog", "figure"]
# The same by class or id: whole words of an attribute.
SKIPPED_CLASS = (
    r"(?i)\b(?:class|id|role)\s*=\s*[\"']?(?:[^\"'>]*[\s_-])?(?:ad|ads|advert|advertisement|banner|breadcrumbs?|comments?|cookies?|disqus|menu|nav|navbar|navigation|newsletter|popup|promo|related|share|sharing|sidebar|social|sponsored|subscribe|widget)(?=[\s\"'>_-])"
)
BLOCKS = [*CONTAINERS, "p", "li", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "tr", "td", "th", "hr", "address", "body", "html", "br"]
GONE = r"(?is)<!--.*?-->|<(script|style|noscript|template|svg|head|textarea|iframe|object|canvas)\b[^>]*>.*?</\1\s*>|<!\[CDATA\[|\]\]>"
TOKEN = r"<[A-Za-z/!?][^>]*>|[^<]+|<"
CHUNK = 256
BREAK, LINK, LINK_END = "\x01", "\x02", "\x03"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: inside a lambda a column would be computed for each element again, a lambda's variable is not."""
    return F.transform(F.array(value), body)[0]


def any_of(names: list[str]) -> str:
    return "|".join(names)


def events(tokens: Column) -> Column:
    """For each token: depth (1 opens a container, -1 closes one), skip and inside (it opens a skipped container, an article), as bits of an int."""

    def event(t: Column) -> Column:
        opens = t.rlike(rf"(?i)^<(?:{any_of(CONTAINERS)})\b[^>]*(?<!/)>")
        closes = t.rlike(rf"(?i)^</(?:{any_of(CONTAINERS)})\s*>")
        skip = t.rlike(rf"(?i)^<(?:{any_of(SKIPPED)})\b") | t.rlike(SKIPPED_CLASS)
        inside = t.rlike(r"(?i)^<(?:article|main)\b")
        return F.when(~t.startswith("<"), 0).when(closes, 1).when(opens, F.lit(2) + F.when(skip, 4).otherwise(0) + F.when(inside, 8).otherwise(0)).otherwise(0)

    return F.transform(tokens, event)


def regions(codes: Column) -> Column:
    """0 for each token in a skipped container, 2 in an article, else 1, from the codes of events().

    A fold with the running depth and the depth at which a region began. Folds that gather copy what they have at each step, so
    it is done in chunks whose results are joined: a page of n tokens costs n steps of at most CHUNK.
    """
    none = F.array().cast("array<int>")
    state = lambda depth, skip, inside, out: F.struct(depth.alias("depth"), skip.alias("skip"), inside.alias("inside"), out.alias("out"))

    def step(acc: Column, code: Column) -> Column:
        depth = acc["depth"] + F.when(code == 1, -1).when(code >= 2, 1).otherwise(0)
        begun = lambda name, bit: F.when(acc[name] != 0, F.when(depth < acc[name], 0).otherwise(acc[name])).when(code.bitwiseAND(bit) != 0, depth).otherwise(0)
        # A region's own tags are breaks whatever side they are on, so the state after the token serves for it too.
        return let(
            F.struct(depth.alias("d"), begun("skip", 4).alias("s"), begun("inside", 8).alias("i")),
            lambda v: state(v["d"], v["s"], v["i"], F.concat(acc["out"], F.array(F.when(v["s"] != 0, 0).when(v["i"] != 0, 2).otherwise(1)))),
        )

    def chunk(acc: Column, part: Column) -> Column:
        start = state(acc["depth"], acc["skip"], acc["inside"], none)
        return let(F.aggregate(part, start, step), lambda v: state(v["depth"], v["skip"], v["inside"], F.concat(acc["out"], v["out"])))

    # Depths start high, so that a page that closes more than it opens never reaches the 0 that stands for no region.
    begin = state(F.lit(1_000_000), F.lit(0), F.lit(0), none)
    return let(codes, lambda c: F.aggregate(F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / CHUNK).cast("int")), lambda i: F.slice(c, i * CHUNK + 1, F.lit(CHUNK))), begin, chunk)["out"])


def marked(tokens: Column) -> Column:
    """The page as one string: text as it is, breaks between blocks, marks around links; other tags are gone. An article's tokens alone, if
    there is one with 200 characters or more, else all outside skipped containers."""

    def piece(t: Column) -> Column:
        tag = F.when(t.rlike(rf"(?i)^</?(?:{any_of(BLOCKS)})\b"), BREAK).when(t.rlike(r"(?i)^<a\b"), LINK).when(t.rlike(r"(?i)^</a\b"), LINK_END).otherwise("")
        return F.when(t.rlike("^<[A-Za-z/!?]"), tag).otherwise(F.translate(t, BREAK + LINK + LINK_END, "   "))

    zipped = F.arrays_zip(tokens.alias("t"), regions(events(tokens)).alias("r"))

    def chosen(z: Column) -> Column:
        # Left out regions stand as breaks, so that what is on both sides of one stays apart.
        read = lambda least: F.array_join(F.transform(z, lambda x: F.when(x["r"] >= least, piece(x["t"])).otherwise(BREAK)), "")
        return let(read(2), lambda own: F.when(F.length(F.regexp_replace(own, "[\x01-\x03\\s]+", "")) >= 200, own).otherwise(read(1)))

    return let(zipped, chosen)


def blocks(marks: Column) -> Column:
    """array<struct<text, words, linked>> of a page's blocks that have text: entities decoded, white space collapsed; linked is the share of
    characters in links."""

    def block(part: Column) -> Column:
        text = let(F.translate(part, LINK + LINK_END, ""), lambda p: F.trim(F.regexp_replace(T.unescape(p), r"(?U)\s+", " ")))
        links = F.array_join(F.regexp_extract_all(part, F.lit("\x02([^\x02\x03]*)"), F.lit(1)), "")
        size = lambda c: F.length(F.regexp_replace(c, "[\x02\x03\\s]+", ""))
        return let(
            text,
            lambda t: F.struct(t.alias("text"), F.size(F.filter(F.split(t, " "), lambda w: w != "")).alias("words"), (size(links) / F.greatest(size(part), F.lit(1))).alias("linked")),
        )

    return F.filter(F.transform(F.filter(F.split(marks, BREAK), lambda p: p.rlike(r"[^\s\x02\x03]")), block), lambda b: b["text"] != "")


def main_blocks(found: Column, long_words: int = 15, linked: float = 1 / 3) -> Column:
    """The texts of blocks that are an article's: few links, and long_words words, or three with a long block next to it."""

    def judged(bs: Column) -> Column:
        none = F.array().cast("array<struct<text:string,words:int,linked:double>>")
        edge = F.array(F.struct(F.lit("").alias("text"), F.lit(0).alias("words"), F.lit(0.0).alias("linked")))
        n = F.size(bs)
        before, after = F.when(n > 0, F.concat(edge, F.slice(bs, 1, n - 1))).otherwise(none), F.when(n > 0, F.concat(F.slice(bs, 2, n), edge)).otherwise(none)
        good = lambda b: (b["words"] >= long_words) & (b["linked"] <= linked)
        rows = F.arrays_zip(before.alias("a"), bs.alias("b"), after.alias("c"))
        kept = F.filter(rows, lambda r: good(r["b"]) | ((r["b"]["words"] >= 3) & (r["b"]["linked"] <= linked) & (good(r["a"]) | good(r["c"]))))
        return F.transform(kept, lambda r: r["b"]["text"])

    return let(found, judged)


def main_text(html: Column) -> Column:
    """The article's text, a line a block; null where no block is one. Null and empty pages have none.

    Comments, scripts, styles and the head go first. Skipped containers are told by tag, class or id, however deep they nest. Attribute
    values that hold a > end their tag early.
    """
    tokens = F.regexp_extract_all(F.regexp_replace(html, GONE, " "), F.lit(TOKEN), F.lit(0))
    return F.nullif(F.array_join(main_blocks(blocks(let(tokens, marked))), "\n"), F.lit(""))


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value as it is written, '' if there is none; quotes of both kinds or none."""
    found = lambda i: F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", i)
    return F.concat(found(1), found(2), found(3))


def metas(html: Column) -> Column:
    """array<struct<key, value>> of the meta tags, keys in lower case, in the page's order."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>"), F.lit(0))
    key = lambda t: F.lower(T.first_of(attribute(t, "name"), attribute(t, "property"), attribute(t, "itemprop"), F.lit("-")))
    return F.transform(tags, lambda t: F.struct(key(t).alias("key"), let(attribute(t, "content"), T.clean_summary).alias("value")))


def linked_data(html: Column) -> Column:
    """The page's JSON-LD scripts, an array of strings."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script"), F.lit(1))


# The keys of meta tags, best first.
TITLE_KEYS = ["og:title", "twitter:title", "dc.title", "title"]
AUTHOR_KEYS = ["author", "article:author", "dc.creator", "dcterms.creator", "parsely-author", "sailthru.author", "byl"]
DATE_KEYS = ["article:published_time", "datepublished", "og:published_time", "date", "pubdate", "publishdate", "dc.date", "dc.date.issued", "dcterms.created", "parsely-pub-date", "sailthru.date"]
AUTHOR_PATHS = ["$.author.name", "$.author[0].name", "$.author[0]", "$.author", "$[0].author.name", "$[0].author[0].name", "$['@graph'][*].author.name"]
DATE_PATHS = ["$.datePublished", "$[0].datePublished", "$['@graph'][*].datePublished", "$.dateCreated"]


def keyed(pairs: Column, keys: list[str], usable: Callable[[Column], Column]) -> Column:
    """The first usable value of the first key that has one."""
    place = F.array(*map(F.lit, keys))
    known = F.filter(pairs, lambda p: p["key"].isin(keys))
    ranked = F.transform(known, lambda p: F.struct(F.array_position(place, p["key"]).alias("place"), usable(p["value"]).alias("value")))
    return first_placed(ranked)


def first_placed(found: Column) -> Column:
    """Of structs (place, value) the first non-null value of the least place that has one."""
    least = lambda xs: F.array_min(F.transform(xs, lambda x: x["place"]))
    return let(F.filter(found, lambda x: x["value"].isNotNull()), lambda xs: let(least(xs), lambda m: F.get(F.filter(xs, lambda x: x["place"] == m), F.lit(0))["value"]))


def pathed(scripts: Column, paths: list[str], usable: Callable[[Column], Column]) -> Column:
    """The first usable value at the first path that has one, of a page's JSON-LD."""
    # A path with a star gives JSON, an array or a quoted string: its first string counts.
    read = lambda s, path: usable(F.regexp_replace(F.get_json_object(s, path), r"(?s)^\[?\"((?:[^\"\\]|\\.)*)\".*$", "$1"))
    values = F.flatten(F.transform(scripts, lambda s: F.array(*[F.struct(F.lit(i).alias("place"), read(s, p).alias("value")) for i, p in enumerate(paths)])))
    return first_placed(values)


def person(value: Column) -> Column:
    """A name, null for what is none: objects, addresses of web pages, blanks; 'By' in front goes."""
    clean = F.trim(F.regexp_replace(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")), r"(?i)^by ", ""))
    return let(clean, lambda name: F.when((name != "") & ~name.rlike(r"^[\[{]|^(?i:https?:)|^//"), name))


def day(value: Column) -> Column:
    """The date that a value begins with, as ISO dates do; null if it begins with none."""
    return F.try_to_date(F.nullif(F.regexp_extract(value, r"^\s*(\d{4}-\d{2}-\d{2})(?!\d)", 1), F.lit("")), "yyyy-MM-dd")


def byline(html: Column) -> Column:
    """The text of the first link or element that is marked as the author's."""
    marked_up = r"(?is)<(?:a|span|p|div|address)\b[^>]*(?:rel\s*=\s*[\"']?author|(?:class|itemprop)\s*=\s*[\"'](?:[^\"'>]*[\s_-])?(?:byline|author)(?=[\s\"'_-]))[^>]*>(.{0,300}?)</(?:a|span|p|div|address)>"
    return let(F.regexp_extract(html, marked_up, 1), T.clean_summary)


def metadata(html: Column, url: Column) -> Column:
    """struct(title, author, published) as a page states them, null where it does not; published is a date.

    Meta tags count first, then JSON-LD; then for the title the title element, for the author a byline, for the date a time element and the
    address (/2026/02/05/). Of several keys the first in the lists above that has a usable value counts, of several values the
    first. JSON that cannot be read says nothing.
    """
    clock = F.regexp_extract(html, r"(?is)<time\b[^>]*\sdatetime\s*=\s*[\"']?([^\"'>\s]+)", 1)
    path = F.concat_ws("-", *[F.regexp_extract(url, r"/(\d{4})[/-](\d{2})[/-](\d{2})(?:[/-]|$)", i) for i in (1, 2, 3)])
    return let(
        F.struct(metas(html).alias("metas"), linked_data(html).alias("linked")),
        lambda v: F.struct(
            F.coalesce(keyed(v["metas"], TITLE_KEYS, lambda x: F.nullif(x, F.lit(""))), T.html_title(html)).alias("title"),
            F.coalesce(keyed(v["metas"], AUTHOR_KEYS, person), pathed(v["linked"], AUTHOR_PATHS, person), person(byline(html))).alias("author"),
            F.coalesce(keyed(v["metas"], DATE_KEYS, day), pathed(v["linked"], DATE_PATHS, day), day(clock), day(path)).alias("published"),
        ),
    )
