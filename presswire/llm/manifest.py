"""Merkle manifest of a dataset: a tree of hashes for each group, one above them, and for each row the proof that leads to the root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswire.llm.common import materialize, small

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """A value as the tree hashes it: its length in UTF-8 bytes, a colon and the value, so that no two rows read alike; - for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    return digest(*[encoded(changed.get(c, F.col(c))) for c in COLUMNS])


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows with pos: 0, 1, ... in ascending order of the columns, nulls first. Equal rows get places next to each other.

    Sorted by ranges, which a row number also cuts, so that equal rows, however many, are dealt to many tasks. The driver gets one number
    for each partition, never a row.
    """
    cut = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie").drop("tie")
    cut = materialize(cut.withColumn("pos", F.monotonically_increasing_id()))
    counts = sorted((r["part"], r["n"]) for r in cut.groupBy(F.shiftright("pos", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, so_far = [], 0
    for part, n in counts:
        starts.append((part, so_far))
        so_far += n
    before = F.broadcast(rows.sparkSession.createDataFrame(starts, "part long, before long"))
    return cut.withColumn("part", F.shiftright("pos", 33)).join(before, "part").withColumn("pos", F.col("before") + F.col("pos").bitwiseAND(2**33 - 1)).drop("part", "before")


def runs(nodes: DataFrame, fan: int) -> DataFrame:
    """nodes (grp, idx, n, digest, ...) with parent, the index of the run of fan nodes they belong to, and run, the run's digests in order.

    The window is keyed by group and parent, so it holds at most fan rows, however large a group is.
    """
    frame = Window.partitionBy("grp", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes.withColumn("parent", F.expr(f"idx div {fan}")).withColumn("run", F.collect_list("digest").over(frame))


def levels(leaves: DataFrame, fan: int) -> list[DataFrame]:
    """The trees' levels from the leaves (grp, idx, n of the group, digest; written) up; a group stops at the level where it has one node.

    Every child holds its parent's preimage, so a run's first child speaks for it: parents are without duplicates and need no shuffle for it.
    """
    out, n = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while n > 1:
        firsts = runs(out[-1].where("n > 1"), fan).where(F.col("idx") % fan == 0)
        out.append(materialize(firsts.select("grp", F.col("parent").alias("idx"), F.expr(f"(n + {fan - 1}) div {fan}").alias("n"), F.sha2(F.array_join("run", ""), 256).alias("digest"))))
        n = -(-n // fan)
    return out


def descend(trees: list[DataFrame], tops: DataFrame, fan: int) -> DataFrame:
    """The leaves with the columns of their group's row in tops (grp, path, ...): path is struct(left, right) of siblings for each level, going
    up from the leaf and on to what tops has."""
    up = None
    for k in reversed(range(len(trees))):
        nodes = trees[k]
        here = nodes.where("n = 1").join(small(tops), "grp")
        if up is not None:
            own = F.struct(F.array_join(F.slice("run", 1, F.col("nth")), "").alias("left"), F.array_join(F.slice("run", F.col("nth") + 2, F.lit(fan)), "").alias("right"))
            rows = runs(nodes.where("n > 1"), fan).withColumn("nth", (F.col("idx") % fan).cast("int")).withColumn("own", own).drop("run", "nth")
            below = rows.join(up, ["grp", "parent"])
            here = here.unionByName(below.withColumn("path", F.concat(F.array("own"), "path")).select(here.columns))
        if k:
            up = materialize(here.select("grp", F.col("idx").alias("parent"), *[c for c in tops.columns if c != "grp"]))
    return here


def manifest(docs: DataFrame, fan: int = 8, every: int = 3) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row: one tree of hashes for each lang, one over their roots.

    A leaf hashes doc_id, source, lang, n_chars and text. Leaves ascend by doc_id; runs of `fan` become one node until one is left, the
    subroot; subroots, by lang, become the root in the same way. proof_sha256 is the hash of all siblings on the way up. The
    check: of rows whose crc32(doc_id) is divisible by `every` the text's A-Z are lowered, and folded_root is what the root would be;
    verified tells whether it is the root.

    Null columns hash as -, other than empty texts; rows without lang are a group of their own, the first. Null doc_ids come first in their
    group and are never tampered with. Rows that repeat a doc_id are leaves of their own, ordered by their hashes; equal rows are
    interchangeable. A group of one row has its leaf as subroot, one group its subroot as root; without siblings the proof is the
    hash of nothing. An empty table gives no rows. Other columns are ignored.

    Texts are hashed where they are read and never shuffled. Leaves get places by sorted ranges, so a lang that holds most rows is dealt to
    many tasks; each level's windows hold `fan` rows. Levels are written, each an eighth of the one below.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    hashed = docs.select("doc_id", "lang", leaf().alias("leaf"), F.when(hit, leaf(text=F.translate("text", UPPER, LOWER))).alias("tampered"))
    rows = placed(materialize(hashed), "lang", "doc_id", "leaf")  # written first: the ranges are found by a run of their own
    groups = placed(materialize(rows.groupBy("lang").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("n"))), "start")
    groups = materialize(groups.select(F.col("lang").alias("of"), "start", "n", F.col("pos").alias("grp")))
    leaves = rows.join(small(groups), F.col("lang").eqNullSafe(F.col("of")))
    trees = levels(materialize(leaves.select("grp", (F.col("pos") - F.col("start")).alias("idx"), "n", F.col("leaf").alias("digest"), "doc_id", "tampered")), fan)
    subroots = trees[0].where("n = 1").select("grp", "digest")
    for level in trees[1:]:
        subroots = subroots.unionByName(level.where("n = 1").select("grp", "digest"))
    above = subroots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("idx"), F.lit(groups.count()).cast("long").alias("n"), "digest")
    above = levels(materialize(above), fan)
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    root = above[-1].select("grp", nothing.alias("path"), F.col("digest").alias("root"))
    tops = materialize(descend(above, root, fan).select(F.col("idx").alias("grp"), F.col("digest").alias("subroot"), "path", "root"))
    out = descend(trees, tops, fan)
    proof = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    folded = F.aggregate("path", F.coalesce("tampered", "digest"), lambda acc, x: digest(x["left"], acc, x["right"]))
    out = out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
