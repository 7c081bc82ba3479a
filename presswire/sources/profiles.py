"""Channel profiles in YAML, JSON, Markdown and plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswire.functions import reports
from presswire.operators.ordered import sections

JSON = "name string, description string, worldview string, worldview_description string, topics array<string>"


def read(spark, path: str) -> DataFrame:
    """path, content of profile files; the kind comes from the extension, others are left out."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("content"))
    return rows.withColumn("kind", F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))).where(F.col("kind").isin("yaml", "yml", "md", "txt", "json"))


def from_json(docs: DataFrame) -> DataFrame:
    """Flat JSON profiles (id, content); a nested one keeps its topics but loses its name."""
    p = F.from_json("content", JSON)
    return docs.select("id", F.coalesce(p["name"], F.lit("")).alias("name"), F.coalesce(p["description"], F.lit("")).alias("description"), F.coalesce(p["topics"], F.array().cast("array<string>")).alias("topics"))


def from_yaml(docs: DataFrame) -> DataFrame:
    """YAML profiles (id, content): name, description, worldview, worldview_description of `channel` (of the document itself without one), topics:
    the primary ones, then the secondary, or a plain list.

    What profiles hold is read: mappings two levels deep, lists of scalars in both notations, quoted scalars, blocks (| and >), comments.
    """
    lines = docs.select("id", F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "raw"))
    text = F.trim(F.regexp_replace("raw", r"^\s*#.*$|\s+#.*$", ""))
    lines = lines.withColumns({"line": text, "indent": F.length(F.regexp_extract("raw", r"^( *)", 1))})
    pattern = r"^([A-Za-z_][A-Za-z0-9_ ]*):(?:\s+(.*))?$"
    own = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    key = F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, 1))
    lines = lines.where("line <> ''").withColumn("key", key)
    # What is indented below a key with | or > is its text, whatever it looks like, up to a line that is not.
    upto = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    block = F.when(F.col("key").isNotNull() & F.regexp_extract("line", pattern, 2).rlike(r"^[|>][+-]?$"), F.struct(F.col("line_no").alias("no"), F.col("indent").alias("indent")))
    lines = lines.withColumn("block", F.last(block, ignorenulls=True).over(upto))
    since = Window.partitionBy("id", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("inside", F.coalesce(F.min("indent").over(since) > F.col("block.indent"), F.lit(False)))
    lines = lines.withColumn("key", F.when(~F.col("inside"), F.col("key")))
    lines = lines.withColumn("top_no", F.last(F.when((F.col("indent") == 0) & F.col("key").isNotNull(), F.col("line_no")), ignorenulls=True).over(own))
    lines = lines.withColumn("top", F.last(F.when((F.col("indent") == 0) & F.col("key").isNotNull(), F.col("key")), ignorenulls=True).over(own))
    inner = Window.partitionBy("id", "top_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sub = F.when((F.col("indent") > 0) & F.col("key").isNotNull(), F.col("key"))
    lines = lines.withColumn("sub", F.last(sub, ignorenulls=True).over(inner))
    bare = lambda c: F.regexp_replace(F.trim(c), r"""^(["'])(.*)\1$""", "$2")
    value = F.when(F.col("key").isNotNull(), F.coalesce(F.regexp_extract("line", pattern, 2), F.lit("")))
    flow = F.when(value.rlike(r"^\[.*\]$"), F.filter(F.transform(F.split(F.regexp_extract(value, r"^\[(.*)\]$", 1), ","), bare), lambda x: x != ""))
    item = F.when(F.col("line").startswith("- ") & ~F.col("inside"), F.array(bare(F.substring("line", 3, 10_000))))
    rows = lines.select("id", "line_no", "top", "sub", value.alias("value"), F.coalesce(flow, item).alias("items"), F.when(F.col("key").isNull() & (F.col("inside") | ~F.col("line").startswith("- ")), F.col("line")).alias("more"))
    rows = rows.withColumn("path", F.when(F.col("top") == "channel", F.col("sub")).when(F.col("top") != "topics", F.col("top")))

    def scalar(name: str) -> Column:
        here = F.col("path") == name
        first = F.max(F.when(here & ~F.col("value").rlike(r"^([|>][+-]?)?$"), bare(F.col("value"))))
        block = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(here & F.col("more").isNotNull(), F.struct("line_no", "more")))), lambda x: x["more"]), "\n")
        return F.coalesce(first, block)

    rank = F.when(F.col("sub") == "primary", 0).when(F.col("sub") == "secondary", 1).when(F.col("sub").isNull(), 0)
    listed = F.array_sort(F.collect_list(F.when((F.col("top") == "topics") & F.col("items").isNotNull() & rank.isNotNull(), F.struct(rank.alias("rank"), F.col("line_no"), F.col("items")))))
    out = rows.groupBy("id").agg(*[scalar(n).alias(n) for n in ("name", "description", "worldview", "worldview_description")], F.flatten(F.transform(listed, lambda x: x["items"])).alias("topics"))
    texts = [F.coalesce(n, F.lit("")).alias(n) for n in ("name", "description", "worldview", "worldview_description")]
    return docs.select("id").join(out, "id", "left").select("id", *texts, F.coalesce("topics", F.array().cast("array<string>")).alias("topics"))


def to_yaml(profiles: DataFrame) -> DataFrame:
    """id, content: profiles (id, name, description, worldview, worldview_description, topics) as flat YAML, which from_yaml() reads back."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"[\r\n]+", " "), '"', "'"), F.lit('"'))
    block = lambda c: F.concat(F.lit("|\n"), F.array_join(F.transform(F.split(c, "\n"), lambda x: F.concat(F.lit("  "), F.trim(x))), "\n"))
    field = lambda name: F.concat(F.lit(f"{name}: "), F.when(F.col(name).contains("\n"), block(F.col(name))).otherwise(quoted(F.col(name))))
    topics = F.concat(F.lit("topics:"), F.array_join(F.transform("topics", lambda t: F.concat(F.lit("\n  - "), quoted(t))), ""))
    return profiles.select("id", F.concat_ws("\n", *[field(n) for n in ("name", "description", "worldview", "worldview_description")], topics).alias("content"))


def from_markdown(docs: DataFrame) -> DataFrame:
    """Markdown profiles (id, content): name, description, worldview, worldview_description, topics from their sections."""
    rows = sections(docs, ["id"], "content", r"^\s*## ").withColumn("line", F.trim("line"))
    is_title = F.col("line").startswith("# ")
    body = rows.where((F.col("line") != "") & ~F.col("line").startswith("## ") & ~is_title & F.col("section").isNotNull())
    kind = (
        F.when(F.lower("section").contains("description") | F.lower("section").contains("about"), "description")
        .when(F.lower("section").rlike("worldview|perspective|bias"), "worldview")
        .when(F.lower("section").contains("topic"), "topics")
    )
    ordered = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.struct("line_no", "line"))))
    bullet = F.col("line").rlike(r"^[-*•]")
    parts = body.withColumn("kind", kind).groupBy("id").agg(
        ordered(F.col("kind") == "description").alias("d"), ordered(F.col("kind") == "worldview").alias("w"), ordered((F.col("kind") == "topics") & bullet).alias("t")
    )
    name = rows.where(is_title).groupBy("id").agg(F.min_by(F.trim(F.substring("line", 3, 10_000)), "line_no").alias("name"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x["line"]), "\n")
    out = docs.select("id").join(name, "id", "left").join(parts, "id", "left")
    view = F.coalesce(text(F.col("w")), F.lit(""))
    topics = F.transform(F.coalesce("t", F.array().cast("array<struct<line_no:int,line:string>>")), lambda x: F.trim(F.regexp_replace(x["line"], r"^[-* •]+", "")))
    return out.select("id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce(text(F.col("d")), F.lit("")).alias("description"), reports.worldview(view).alias("worldview"), view.alias("worldview_description"), topics.alias("topics"))


def from_text(docs: DataFrame) -> DataFrame:
    """Plain profiles: the first line shorter than 100 characters is the name, the other lines the description."""
    lines = F.filter(F.transform(F.split("content", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    at = F.array_position(F.transform(lines, lambda x: F.length(x) < 100), True)
    rest = F.filter(F.zip_with(lines, F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: (p["i"] != at) & p["x"].isNotNull())
    return docs.select("id", F.coalesce(F.when(at > 0, F.try_element_at(lines, F.greatest(at, F.lit(1)).cast("int"))), F.lit("")).alias("name"), F.array_join(F.transform(rest, lambda p: p["x"]), "\n").alias("description"))
