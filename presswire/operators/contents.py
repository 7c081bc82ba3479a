"""Message contents of any depth as text: strings, objects and lists that hold one another, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswire.operators.store import cut

# Types of list items that are text.
TEXT_TYPES = ["text", "input_text", "output_text"]
NODE = "array<struct<pos:int,text:string,below:variant>>"


def is_a(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def said(v: Column, path: str) -> Column:
    """A field's text, null where it is missing or empty."""
    return F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))


def opened(v: Column) -> Column:
    """NODE: what a content is made of. Of a list its parts, in order: texts, and contents below (text is null); else one part (pos -1), its text or
    the content that stands in its place."""

    def part(x: Column, i: Column) -> Column:
        typed = F.coalesce(F.try_variant_get(x, "$.type", "string").isin(TEXT_TYPES), F.lit(False))
        below = F.try_variant_get(x, "$.content", "variant")
        held = is_a(x, "OBJECT") & ~typed & below.isNotNull()
        own = F.when(typed, said(x, "$.text")).when(is_a(x, "OBJECT"), said(x, "$.output")).otherwise(F.try_variant_get(x, "$", "string"))
        return F.struct(i.alias("pos"), F.when(~held, own).alias("text"), F.when(held, below).alias("below"))

    below = F.try_variant_get(v, "$.content", "variant")
    keyed = F.coalesce(said(v, "$.text"), said(v, "$.output"))
    placed = is_a(v, "OBJECT") & keyed.isNull() & below.isNotNull()
    text = F.when(is_a(v, "OBJECT"), F.coalesce(keyed, F.to_json(v))).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")))
    one = F.array(F.struct(F.lit(-1).alias("pos"), F.when(~placed, text).alias("text"), F.when(placed, below).alias("below")))
    return F.when(is_a(v, "ARRAY"), F.transform(F.try_variant_get(v, "$", "array<variant>"), part)).otherwise(one).cast(NODE)


def texts(messages: DataFrame, key: str, content: str) -> DataFrame:
    """key, text of messages whose content is JSON: a string; an object's text or output, else its content's text, else its JSON; a list's parts, a line
    each: strings, texts of typed items, contents of others unless they are empty, outputs. No content and null are ''.

    Contents are opened a level at a time until none is left below, and joined again from the deepest level up, so nesting has no bound and each
    level is one pass over what is still open. Keys are unique and not null.
    """
    open_, done, depth = cut(messages.select(F.col(key).alias("k"), F.array().cast("array<int>").alias("path"), F.try_parse_json(content).alias("v"))), [], 0
    while not open_.isEmpty():
        # A content in place of another stands where that stood (pos -1); parts of a list stand one step further.
        parts = open_.select("k", "path", F.posexplode(opened(F.col("v"))).alias("i", "n"))
        place = F.when(F.col("n.pos") < 0, F.col("path")).otherwise(F.concat("path", F.array("n.pos")))
        parts = parts.select("k", place.alias("path"), "n.text", "n.below", "n.pos")
        # A list's own strings are parts even if empty; a content below a list that has no text is none.
        done.append(cut(parts.where("text <> '' or (text = '' and (pos >= 0 or size(path) = 0))").select("k", "path", "text")))
        open_, depth = cut(parts.where("below is not null").select("k", "path", F.col("below").alias("v"))), depth + 1
    found = messages.select(F.col(key).alias("k"), F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("text")).limit(0)
    for d in done:
        found = found.unionByName(d)
    for d in range(depth, 0, -1):
        here, rest = found.where(F.size("path") == d), found.where(F.size("path") < d)
        joined = here.groupBy("k", F.slice("path", 1, d - 1).alias("path")).agg(F.array_sort(F.collect_list(F.struct(F.element_at("path", -1).alias("pos"), "text"))).alias("ps"))
        joined = joined.select("k", "path", F.array_join(F.transform("ps", lambda p: p["text"]), "\n").alias("text"))
        found = cut(rest.unionByName(joined.where((F.size("path") == 0) | (F.col("text") != ""))))
    return messages.select(key).join(found.select(F.col("k").alias(key), "text"), key, "left").withColumn("text", F.coalesce("text", F.lit("")))
