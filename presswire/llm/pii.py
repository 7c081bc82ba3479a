"""Personal data: fixed forms in whole texts, and identifiers of other forms that the words around the fixed ones lead to."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswire.llm.common import bucket, materialize, small, with_package

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# The fixed forms, one pass each. Runs are possessive and an address is read outwards from its @, so no text takes more than a few passes.
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Other forms that an identifier may have; which kinds one can be is told by its parts.
SIGN = r"(?:@|\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?)"
DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?)"
LOOSE_AT = re.compile(rf"{SIGN}[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)*", re.IGNORECASE)
MARKS = re.compile(r"\s?[\[({<]\s?(at|@|dot|\.)\s?[\])}>]\s?", re.IGNORECASE)
DIGIT = re.compile("[0-9]")
NUMBER = re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ ().\[\]/-]{0,3}[0-9])++")
COLONS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Za-z:])")
TOKEN = re.compile(r"\w+|[^\w\s]")
LONGEST = 64  # characters of a token of a context that count; longer ones read alike in them
OCCURRENCE = "kind int, base boolean, start int, end int, value string, contexts array<string>"
FOUND = f"doc_id long, occurrences array<struct<{', '.join(f'{n}:{t}' for n, t in (c.split(' ') for c in OCCURRENCE.split(', ')))}>>"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def addresses(text: str, sign: re.Pattern) -> Iterator[tuple[int, int]]:
    """Spans around a sign: the run of address characters before it, as far as the span before it lets it, and the domain."""
    since = 0
    for m in sign.finditer(text):
        before = text[since : m.start()]
        n = len(before) - len(before.rstrip(LOCAL))
        since = m.end() if n else m.start() + 1
        if n:
            yield m.start() - n, m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed forms, by kind and start: leftmost ones that do not overlap in their kind; those that fail their
    check go, and nothing is looked for inside them."""
    out = [(0, a, b) for a, b in addresses(text, AT)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def loose_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what has the build of an identifier without being one of the fixed forms; a span may be of two kinds.

    email: a sign of any form and a domain, with dots or without. ip: four numbers up to 255 with dots of any form, or groups
    with colons. card: 12 to 19 digits. phone: 7 to 15 digits. What overlaps a fixed form, or one of these found before, is none.
    """
    held = sorted({(a, b) for _, a, b in taken})
    starts, ends = [a for a, _ in held], []
    for _, b in held:
        ends.append(max(b, ends[-1] if ends else 0))
    out, last = [], -1

    def free(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return i == 0 or ends[i - 1] <= a

    found = [(a, b, (0,)) for a, b in addresses(text, LOOSE_AT)] if any(c in text for c in "@[({<") else []
    found += [(*m.span(), (1,)) for m in COLONS.finditer(text)] if text.count(":") >= 3 else []
    for m in NUMBER.finditer(text) if DIGIT.search(text) else ():
        if m.end() - m.start() > 80 or text[m.end() : m.end() + 1].isalnum():  # 19 digits with three separators each are no longer
            continue
        parts = re.findall("[0-9]+", m[0])
        n = sum(map(len, parts))
        dotted = len(parts) == 4 and m[0].count(".") == 3 and all(int(p) <= 255 for p in parts)
        kinds = (1,) if dotted else tuple(k for k, low, high in ((2, 12, 19), (3, 7, 15)) if low <= n <= high)
        if kinds:
            found.append((*m.span(), kinds))
    for a, b, kinds in sorted(found):
        if a >= last and free(a, b):
            out += [(k, a, b) for k in kinds]
            last = b
    return out


def value_of(kind: int, text: str) -> str:
    """What makes two spans the same identifier: digits, or the address with plain signs; hashed, so that none is stored as it is."""
    if kind == 0:
        plain = MARKS.sub(lambda m: "@" if m[1].lower() in ("at", "@") else ".", text).lower()
    elif kind == 1:
        plain = text.lower() if ":" in text else ".".join(p.lstrip("0") or "0" for p in re.findall("[0-9]+", text))
    else:
        plain = re.sub("[^0-9]", "", text)
    return hashlib.blake2b(plain.encode("utf-8", "replace"), digest_size=12).hexdigest()


def contexts_of(words: list[str], before: int, after: int) -> list[str]:
    """The patterns at a place: two and three tokens before it, two after it. A blank stands for the place."""
    out = [" ".join(words[before - n : before]) + " " for n in (2, 3) if before >= n]
    return out + ([" " + " ".join(words[after : after + 2])] if after + 2 <= len(words) else [])


def occurrences(text: str) -> list[tuple]:
    """Rows of OCCURRENCE of a text: fixed forms first, by kind and start, then loose ones."""
    base = base_spans(text)
    loose = loose_spans(text, base)
    if not base and not loose:
        return []
    tokens = list(TOKEN.finditer(text))
    starts, ends, words = [m.start() for m in tokens], [m.end() for m in tokens], [m[0].lower()[:LONGEST] for m in tokens]
    return [
        (k, i < len(base), a, b, value_of(k, text[a:b]), contexts_of(words, bisect_right(ends, a), bisect_left(starts, b)))
        for i, (k, a, b) in enumerate([*base, *loose])
    ]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split(" ")[0] for c in OCCURRENCE.split(", ")]
    for batch in batches:
        found = [[dict(zip(names, o, strict=True)) for o in occurrences(t.as_py())] for t in batch.column("text")]
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("base", pa.bool_()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("contexts", pa.list_(pa.string()))]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "occurrences"])


def find(docs: DataFrame) -> DataFrame:
    """row, doc_id, occurrences of every text; written, so rows keep their numbers."""
    with_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return materialize(rows.mapInArrow(_find, FOUND).withColumn("row", F.monotonically_increasing_id()))


def totals(docs: DataFrame, contexts: DataFrame, block: int = 50_000) -> DataFrame:
    """words, total: how often each run of two or three tokens stands anywhere in the texts. contexts: rows of one column, words, written.

    They go to the tasks in blocks of about `block`, one pass over the texts each, so what is sent has a fixed size.
    """
    with_package(docs.sparkSession)
    n = -(-contexts.count() // block)
    out = docs.sparkSession.createDataFrame([], "words string, total long")
    for b in range(n):
        asked = {r["words"] for r in contexts.where(bucket(n, "words") == b).collect()}
        lasts = {c.rsplit(" ", 1)[1] for c in asked}

        def count(batches: Iterator[pa.RecordBatch], asked=asked, lasts=lasts) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seen: Counter = Counter()
                for text in batch.column("text"):
                    words = [w.lower()[:LONGEST] for w in TOKEN.findall(text.as_py())]
                    for i in [i for i, w in enumerate(words) if w in lasts]:
                        for c in (" ".join(words[i - 1 : i + 1]) if i else "", " ".join(words[i - 2 : i + 1]) if i > 1 else ""):
                            if c in asked:
                                seen[c] += 1
                if seen:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["words", "n"])

        texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
        out = out.unionByName(texts.mapInArrow(count, "words string, n long").groupBy("words").agg(F.sum("n").alias("total")))
    return materialize(out)


def discovered(found: DataFrame, docs: DataFrame, rounds: int = 4, least_values: int = 3, confident: float = 0.5, accept: float = 0.5) -> DataFrame:
    """kind, value, score of the identifiers that contexts lead to, fixed forms left out. found: rows of find().

    A graph of patterns (kind, context) and instances (kind, value) that stand in them. Fixed forms have score 1, others start at
    0 (a value that is also found in fixed form has 1). In each round a pattern's confidence is the scores of its occurrences over
    1 + all places where its context stands in the corpus, whatever follows there; it counts from `confident` on and with
    `least_values` different values of score `accept` or more. An instance's new score is 1 - the product of (1 - confidence) of its
    patterns that count. So new instances support patterns that seeds alone did not.

    Patterns that could never be confident, since even all their occurrences are too few, go before the first round. All joins are of
    aggregated edges; a hot pattern is one row for each of its values, and adaptive execution splits it.
    """
    spark = found.sparkSession
    each = found.select(F.explode("occurrences").alias("o")).select("o.*")
    edges = each.select("kind", "value", "base", F.explode("contexts").alias("context"))
    edges = materialize(edges.groupBy("kind", "context", "value").agg(F.count(F.lit(1)).alias("n"), F.max("base").alias("seed")))
    patterns = edges.groupBy("kind", "context").agg(F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("n")).where(F.col("n_values") >= least_values)
    patterns = materialize(patterns.withColumn("words", F.trim("context")))
    seen = totals(docs, materialize(patterns.select("words").distinct()))
    able = materialize(patterns.join(seen, "words").where(F.col("n") >= confident * (F.col("total") + 1)).select("kind", "context", "total"))
    edges = materialize(edges.join(small(able), ["kind", "context"]))
    scores = materialize(edges.groupBy("kind", "value").agg(F.max("seed").cast("double").alias("score")))
    # A value's fixed form may stand outside these patterns.
    seeds = materialize(each.where("base").select("kind", "value").distinct())
    scores = materialize(scores.join(seeds.withColumn("known", F.lit(1.0)), ["kind", "value"], "left").select("kind", "value", F.coalesce("known", "score").alias("score")))
    for _ in range(rounds if not able.isEmpty() else 0):
        lit = edges.join(scores, ["kind", "value"])
        sure = lit.groupBy("kind", "context", "total").agg(F.sum(F.col("n") * F.col("score")).alias("s"), F.count_if(F.col("score") >= accept).alias("n_values"))
        sure = materialize(sure.withColumn("confidence", F.col("s") / (F.col("total") + 1)).where((F.col("n_values") >= least_values) & (F.col("confidence") >= confident)).select("kind", "context", "confidence"))
        against = edges.join(small(sure), ["kind", "context"]).groupBy("kind", "value").agg(F.sum(F.log1p(-F.least("confidence", F.lit(1 - 1e-9)))).alias("against"))
        new = scores.join(against, ["kind", "value"], "left").join(seeds.withColumn("known", F.lit(1.0)), ["kind", "value"], "left")
        new = materialize(new.select("kind", "value", F.coalesce("known", 1 - F.exp("against"), F.lit(0.0)).alias("score")))
        same = new.join(scores.withColumnRenamed("score", "old"), ["kind", "value"]).where(F.abs(F.col("score") - F.col("old")) > 1e-12).isEmpty()
        scores = new
        if same:
            break
    loose = each.where("not base").select("kind", "value").distinct()
    known = seeds.join(loose, ["kind", "value"]).withColumn("score", F.lit(1.0))
    got = scores.where(F.col("score") >= accept).join(seeds, ["kind", "value"], "left_anti")
    return materialize(got.unionByName(known))


def spans_text(spans: Column) -> Column:
    """kind:start:end of structs (kind, start, end), by kind and start, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(F.get(name, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every whole text; null texts are empty.

    Fixed forms are counted and hashed; spans also holds the occurrences of identifiers that discovered() adds. One that can be of two
    kinds gets that of higher score, then of the first in KINDS. Added spans overlap nothing else. Offsets are code points.

    Every row is judged by its own text: null and repeated doc_ids are rows like others. Copies of a text count as often as they stand
    there, but their values are one. A text without identifiers gets zeros and empty strings; an empty table gives no rows. Other
    columns are ignored. Documents are read twice, once for the identifiers and once for the contexts' totals; what is
    written are occurrences, never texts.
    """
    found = find(docs)
    best = small(discovered(found, docs))
    each = found.select("row", F.explode("occurrences").alias("o")).where("not o.base").select("row", "o.kind", "o.value", "o.start", "o.end")
    chosen = F.min_by(F.struct("kind", "start", "end"), F.struct(-F.col("score"), F.col("kind")))
    added = each.join(best, ["kind", "value"]).groupBy("row", "start").agg(chosen.alias("s")).groupBy("row").agg(F.collect_list("s").alias("added"))
    rows = found.join(materialize(added), "row", "left")
    plain = F.transform(F.filter("occurrences", lambda o: o["base"]), lambda o: F.struct(o["kind"].alias("kind"), o["start"].alias("start"), o["end"].alias("end")))
    none = F.array().cast(T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("kind", "start", "end")])))
    rows = rows.select("doc_id", plain.alias("base"), F.coalesce("added", none).alias("added"))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.concat("base", "added")).alias("spans"))
