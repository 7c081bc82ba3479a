"""Reports and channel profiles in Markdown: matrix links, footnotes, sections, formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswire.functions.text import once
from presswire.functions.urls import normalize

# How reports mark their source matrix, headings and links.
MATRIX = r"(?i)^#{1,6}\s*\d*\.?\s*source matrix"
HEADING = r"^#{1,6}\s+"
LINK = r"\[[^\]]+\]\((https?://[^)]+)\)"
# Views of the world that a profile may name, in the order in which they are looked for.
WORLDVIEWS = ["libertarian", "conservative", "liberal", "progressive", "centrist"]


def lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\n|\r")


def until(lines: Column, stops: Callable[[Column], Column]) -> Column:
    """The lines before the first that stops; all if none does."""
    at = F.array_position(F.transform(lines, stops), True)
    return once(at, lambda n: F.when(n == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(n - 1, F.lit(0)).cast("int"))))


def after(lines: Column, at: Column) -> Column:
    """The lines that follow the one of number `at`."""
    return F.slice(lines, (at + 1).cast("int"), F.size(lines))


def matrix_lines(report: Column) -> Column:
    """The lines of the first source matrix section, up to the next heading; [] without one."""

    def section(every: Column, at: Column) -> Column:
        rest = once(after(every, at), lambda x: until(x, lambda line: line.rlike(HEADING)))
        return F.when(at == 0, F.array().cast("array<string>")).otherwise(F.concat(F.slice(every, F.greatest(at, F.lit(1)).cast("int"), F.lit(1)), rest))

    return once(lines(report), lambda every: once(F.array_position(F.transform(every, lambda x: x.rlike(MATRIX)), True), lambda at: section(every, at)))


def matrix_urls(report: Column) -> Column:
    return F.regexp_extract_all(F.array_join(matrix_lines(report), "\n"), F.lit(LINK), F.lit(1))


def footnote_urls(report: Column) -> Column:
    """The first URL of each footnote, without closing punctuation."""
    notes = F.filter(lines(report), lambda x: F.trim(x).rlike(r"^\[\^\d+\]:"))
    found = F.transform(notes, lambda x: F.regexp_extract(x, r"(https?://\S+)", 1))
    return F.transform(F.filter(found, lambda u: u != ""), lambda u: F.regexp_replace(u, r"[).,;]+$", ""))


def outside(urls: Column, allowed: Column) -> Column:
    """The URLs whose key is none of the allowed ones', in order, with repeats."""
    keys = F.transform(F.filter(allowed, lambda u: F.coalesce(u, F.lit("")) != ""), normalize)
    return once(keys, lambda known: F.filter(urls, lambda u: ~F.array_contains(known, normalize(u))))


def report_error(report: Column, allowed: Column) -> Column:
    """The first complaint about a report's sources; null if there is none."""
    listed = lambda urls: F.array_join(F.slice(urls, 1, 5), ", ")

    def complaint(matrix: Column, unknown: Column, stray: Column) -> Column:
        return (
            F.when(F.size(matrix) == 0, "missing source matrix")
            .when(F.size(unknown) > 0, F.concat(F.lit("unknown sources: "), listed(unknown)))
            .when(F.size(stray) > 0, F.concat(F.lit("footnotes outside matrix: "), listed(stray)))
        )

    def judged(matrix: Column, notes: Column) -> Column:
        return once(outside(matrix, allowed), lambda unknown: once(outside(notes, matrix), lambda stray: complaint(matrix, unknown, stray)))

    return once(report, lambda r: once(matrix_urls(r), lambda matrix: once(footnote_urls(r), lambda notes: judged(matrix, notes))))


def matrix_table(report: Column) -> Column:
    """array<array<string>>: header and rows of the matrix section's first table, for export. The heading must stand alone here and
    the section runs to the next heading of its level or above."""
    mark = lambda x: F.length(F.regexp_extract(x, r"^(#{1,6})\s+", 1))
    cells = lambda x: F.transform(F.split(F.regexp_replace(F.regexp_replace(F.trim(x), r"^\|", ""), r"\|$", ""), r"\|"), lambda c: F.trim(c))
    ends = lambda level: lambda x: once(mark(x), lambda m: (m > 0) & (m <= level))

    def section(every: Column, at: Column) -> Column:
        level = F.length(F.regexp_extract(F.try_element_at(every, F.greatest(at, F.lit(1)).cast("int")), r"^(#{1,6})", 1))
        return once(level, lambda n: once(after(every, at), lambda x: until(x, ends(n))))

    def table(at: Column, section: Column, head: Column) -> Column:
        rows = once(F.slice(section, (head + 2).cast("int"), F.size(section)), lambda body: until(body, lambda x: ~x.contains("|")))
        first = F.try_element_at(section, F.greatest(head, F.lit(1)).cast("int"))
        return once(rows, lambda rs: F.when((at > 0) & (head > 0) & (F.size(rs) > 0), F.concat(F.array(cells(first)), F.transform(rs, cells))))

    def headed(at: Column, section: Column) -> Column:
        pairs = F.zip_with(section, F.slice(section, F.lit(2), F.greatest(F.size(section), F.lit(1))), lambda a, b: a.contains("|") & F.coalesce(b.rlike(r"^\s*\|?\s*:?-{3,}"), F.lit(False)))
        return once(F.array_position(pairs, True), lambda head: table(at, section, head))

    heading = lambda every: F.array_position(F.transform(every, lambda x: x.rlike(r"(?i)^#{1,6}\s+source matrix\s*:?\s*$")), True)
    return once(lines(report), lambda every: once(heading(every), lambda at: once(section(every, at), lambda x: headed(at, x))))


def csv_line(cells: Column) -> Column:
    quoted = F.transform(cells, lambda c: F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c))
    return F.array_join(quoted, ",")


def detect_format(text: Column) -> Column:
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    first = F.split_part(bare, F.lit("\n"), F.lit(1))
    return F.when(bare.rlike(r"^[{\[]"), "json").when(first.contains(":") & ~bare.startswith("#"), "yaml").when(bare.startswith("#"), "md").otherwise("txt")


def worldview(section: Column) -> Column:
    words = F.split(F.lower(section), r"\s+")
    return F.coalesce(*[F.when(F.array_contains(words, w), F.lit(w)) for w in WORLDVIEWS], F.lit(""))


def youtube_id(url: Column) -> Column:
    first = F.regexp_extract(url, r"(?:youtube\.com/watch\?v=|youtu\.be/|youtube\.com/embed/)([a-zA-Z0-9_-]{11})", 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(F.regexp_extract(url, r"youtube\.com/shorts/([a-zA-Z0-9_-]{11})", 1), F.lit("")))


def failure_code(status: Column, page: Column) -> Column:
    """What an extraction that gave no text is recorded as: blocked by 403 or a captcha, an exception from 400 on, else a parse failure."""
    blocked = F.coalesce(status == 403, F.lit(False)) | F.coalesce(F.lower(page).contains("captcha"), F.lit(False))
    return F.when(blocked, "blocked_challenge").when(status >= 400, "exception").otherwise("parse_failure")


def failure_record(status: Column, page: Column) -> Column:
    """struct(text, success, error_code, http_status) of a failed extraction."""
    return F.struct(F.lit("").alias("text"), F.lit(False).alias("success"), failure_code(status, page).alias("error_code"), status.alias("http_status"))


def context_card(name: Column, worldview: Column, description: Column, topics: Column) -> Column:
    """A channel's card for prompts: 500 characters of the description, ten topics; a fixed text without a profile (null name)."""
    lines = ["Channel Profile:", F.concat(F.lit("- Name: "), name), F.concat(F.lit("- Worldview: "), worldview), F.concat(F.lit("- Description: "), F.substring(description, 1, 500)), F.concat(F.lit("- Topics: "), F.array_join(F.slice(topics, 1, 10), ", "))]
    card = F.concat(*[x for line in lines for x in ((F.lit(line) if isinstance(line, str) else line), F.lit("\n"))])
    return F.coalesce(card, F.lit("Channel Profile: Not configured. Using default settings."))
