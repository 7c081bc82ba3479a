"""Text: tokens, counts, summaries, redaction, HTML."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5, name2codepoint
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens left out of matching.
TOKEN_STOP = ["the", "and", "for", "with", "from", "that", "this"]
# Parts of pages that block readers.
BLOCKED = ["access denied", "captcha", "robot", "bot detection", "verify you are human", "challenge", "geo.captcha-delivery.com", "datadome"]
# Lexicons of the fallback classifier.
LEFT_WORDS = ["progressive", "social justice", "inequality", "systemic", "marginalized"]
RIGHT_WORDS = ["freedom", "liberty", "constitution", "traditional", "patriot"]
LIBERTARIAN_WORDS = ["libertarian", "non-intervention", "individual rights", "civil liberties"]
# Secrets (pattern, whether group 1 stays), applied in this order.
SECRETS = [
    (r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]+", True),
    (r"(?i)(api[_-]?key\s*[:=]\s*)[^\s,;]+", True),
    (r"(?i)(authorization\s*[:=]\s*)(?:bearer\s+)?[^\n\r,;]+", True),
    (r"(?i)(cookie\s*[:=]\s*)[^\n\r]+", True),
    (r"(?i)(refresh[_-]?token\s*[:=]\s*)[^\s,;]+", True),
    (r"(?i)(access[_-]?token\s*[:=]\s*)[^\s,;]+", True),
    (r"\bsk-[A-Za-z0-9_-]{8,}\b", False),
    (r"\b[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\b", False),
]
# HTML 4's names of characters and apos, from Python's tables; those that HTML lets go without semicolon.
NAMED = {n: chr(c) for n, c in name2codepoint.items()} | {"apos": "'"}
BARE = sorted((n for n in NAMED if n in html5), key=lambda n: (-len(n), n))
ENTITY = r"&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]{1,31};?)"
# Numbers from 128 to 159 stand for characters of this code page.
LATIN = {i: bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(128, 160)}
# Markers of the rhetoric rubric.
RHETORIC = {
    "prescriptive": ["should", "must", "ought"],
    "hedge": ["may", "might", "seems", "suggests", "probably", "possibly"],
    "bandwagon": ["everyone knows"],
    "passive_agency": ["mistakes were made"],
}


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often `then` uses it; a column used n times in an expression is computed n times,
    and inside a lambda again for each element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def runs(text: Column, letters: str, least: int) -> Column:
    """The runs of `least` or more of these letters. By splitting, in one pass: regexp_extract_all copies the text for each match."""
    return F.filter(F.split(text, f"[^{letters}]+"), lambda w: F.length(w) >= least)


def tokens(text: Column) -> Column:
    """Distinct tokens of three or more letters or digits, without the stop list."""
    return F.array_except(F.array_distinct(runs(F.lower(text), "a-z0-9", 3)), F.array(*map(F.lit, TOKEN_STOP)))


def long_words(text: Column, limit: int = 500) -> Column:
    """The first words of four or more letters."""
    return F.slice(runs(F.lower(text), "a-z", 4), 1, limit)


def count_of(text: Column, part: Column) -> Column:
    """Occurrences of part in text that do not overlap; 0 for an empty part."""
    return F.when(part == "", F.lit(0)).otherwise(((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int"))


def present(text: Column, words: list[str]) -> Column:
    """How many of the words occur in text."""
    low = F.lower(text)
    out = F.lit(0)
    for w in words:
        out = out + low.contains(w).cast("int")
    return out


def any_present(text: Column, words: list[str]) -> Column:
    return present(text, words) > 0


def score_two_sided(text: Column, margin: int = 2) -> Column:
    """-2, 2 or 0: the side whose lexicon has more than margin words more in the text."""
    left, right = present(text, LEFT_WORDS), present(text, RIGHT_WORDS)
    return F.when(left > right + margin, -2).when(right > left + margin, 2).otherwise(0)


def score_three_sided(text: Column, margin: int = 3) -> Column:
    """struct(bias, category): as above, but libertarian words come first if they are more than either side's."""
    left, right, third = present(text, LEFT_WORDS), present(text, RIGHT_WORDS), present(text, LIBERTARIAN_WORDS)
    free = (third > left) & (third > right)
    return F.struct(F.when(free, 0).when(left > right + margin, -2).when(right > left + margin, 2).otherwise(0).alias("bias"), F.when(free, "libertarian").alias("category"))


def code_point(n: Column) -> Column:
    """The character of a number, as HTML has it: the replacement character for null, 0, surrogates and numbers beyond Unicode, nothing for
    control characters."""
    low = F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*LATIN.items())]), n.cast("int"))
    control = n.between(1, 8) | n.between(14, 31) | n.isin(11, 127)
    bad = n.isNull() | (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    return F.when(bad, "\ufffd").when(control, "").when(n.between(128, 159), low).otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


def entity(found: Column) -> Column:
    """What an entity stands for. Of a name that is none the longest beginning that HTML lets go without semicolon counts, else it stays as it is."""
    named = F.str_to_map(F.lit("\x02".join("\x01".join(pair) for pair in NAMED.items())), F.lit("\x02"), F.lit("\x01"))  # a constant, folded once
    name = F.substring(found, 2, 40)
    digits = F.regexp_replace(name, "^#[xX]?|;$", "")
    short = F.length(F.ltrim(digits, F.lit("0"))) <= 8
    number = F.when(short & name.rlike("^#[xX]"), F.conv(digits, 16, 10).try_cast("long")).when(short, digits.try_cast("long"))
    whole = F.when(name.endswith(";"), F.try_element_at(named, F.regexp_replace(name, ";$", "")))
    bare = F.regexp_extract(name, f"^({'|'.join(BARE)})", 1)
    start = F.when(bare != "", F.concat(F.try_element_at(named, bare), F.substring(name, F.length(bare) + 1, F.lit(40))))
    return F.when(name.startswith("#"), code_point(number)).otherwise(F.coalesce(whole, start, found))


def unescape(text: Column) -> Column:
    """HTML's entities decoded in one pass, so nothing is decoded twice: numbers, and names with their semicolon or, where HTML allows it, without."""
    # Zipped, so that a lambda sees a part and its entity as values; a column inside it would be computed again for each entity.
    parts = F.arrays_zip(F.split(text, ENTITY, -1).alias("between"), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)).alias("found"))
    decoded = F.transform(parts, lambda p: F.concat(p["between"], F.when(p["found"].isNotNull(), entity(p["found"])).otherwise("")))
    return F.when(text.contains("&"), F.array_join(decoded, "")).otherwise(text)


def clean_summary(text: Column) -> Column:
    """Tags to spaces, entities decoded, white space (any of Unicode's) collapsed."""
    plain = unescape(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " "))
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def html_title(html: Column) -> Column:
    return F.nullif(clean_summary(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def html_text(html: Column) -> Column:
    """Main text by tag stripping: scripts, styles and the head go first."""
    body = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1>", " ")
    return clean_summary(body)


def redact(text: Column) -> Column:
    for pattern, keep in SECRETS:
        text = F.regexp_replace(text, pattern, "$1[REDACTED]" if keep else "[REDACTED]")
    return text


def split_values(text: Column) -> Column:
    """Comma or line separated input: trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, "[,\n]"), lambda x: F.trim(x)), lambda x: x != "")


def first_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def first_of(*columns: Column) -> Column:
    """The first that is not null and not ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])
