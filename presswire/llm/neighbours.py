"""Embedding near-dedup by NN-descent."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswire.llm.common import few, keep_last, materialize, numbered, with_package
from presswire.llm.graph import blocks, components, sized
from presswire.llm.jaccard import segments, spanning
from presswire.llm.topk import usable

LISTS = "id long, other long, sim double, room int"
log = logging.getLogger(__name__)


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Unit rows in doubles; vectors of unequal length count as padded with zeros."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    scale = np.abs(out).max(axis=1, keepdims=True, initial=0)  # so that squares neither overflow nor vanish
    out = out / np.where(scale > 0, scale, 1)
    return out / np.sqrt((out**2).sum(axis=1, keepdims=True))


def _nearest(ids: np.ndarray, u: np.ndarray, room: np.ndarray, threshold: float) -> pd.DataFrame:
    """Of rows that are compared with one another: each one's nearest (as many as its list has room for) and, room 0, links
    that span the groups linked among them, so that no link found is lost with a full list."""
    sim = u @ u.T
    np.fill_diagonal(sim, -np.inf)
    k = min(int(room.max(initial=1)), len(ids) - 1)
    best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(sim, best, axis=1)
    rank = np.argsort(np.argsort(-value, axis=1), axis=1)
    ok = (rank < room[:, None]) & np.isfinite(value)
    row = np.nonzero(ok)[0]
    near = pd.DataFrame({"id": ids[row], "other": ids[best[ok]], "sim": value[ok], "room": room[row]})
    link = sim >= threshold
    has = np.flatnonzero(link.any(axis=1))
    if not len(has):
        return near
    label = spanning(link[np.ix_(has, has)])
    other = np.flatnonzero(label != np.arange(len(has)))
    return pd.concat([near, pd.DataFrame({"id": ids[has[other]], "other": ids[has[label[other]]], "sim": 1.0, "room": 0})])


def start_lists(nodes: DataFrame, k: int, leaf: int, rounds: int, threshold: float, seed: int) -> DataFrame:
    """First lists: in each round, random hyperplanes part each label's vectors into cells of about `leaf` rows, compared inside."""
    sizes = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))

    def sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            u = _matrix(batch["vector"])
            for r in range(rounds):
                planes = np.random.default_rng([seed, r, u.shape[1]]).standard_normal((u.shape[1], 40))
                bits = (u @ planes > 0).astype(np.int64)
                use = np.ceil(np.log2(np.maximum(batch["n"].to_numpy() / leaf, 1))).astype(np.int64)
                code = (bits * (np.arange(40)[None, :] < use[:, None])) @ (1 << np.arange(40))
                yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "round": r, "code": code})

    # Cells are found and cut to slices without vectors; the written counts let a hot cell's join be split.
    cells = materialize(nodes.join(sizes, "label").mapInPandas(sides, "id long, label long, round int, code long"))
    full = materialize(cells.groupBy("label", "round", "code").agg(F.count(F.lit(1)).alias("cell_rows")))
    cells = cells.join(full, ["label", "round", "code"]).withColumn("slice", F.pmod(F.xxhash64(F.col("round") + seed, "id"), F.ceil(F.col("cell_rows") / (2 * leaf)))).join(nodes.select("id", "vector"), "id")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        u, ids = _matrix(frame["vector"]), frame["id"].to_numpy()
        out = []
        for at in frame.groupby(["label", "round", "code", "slice"]).indices.values():
            if len(at) > 1:
                out.append(_nearest(ids[at], u[at], np.full(len(at), k), threshold))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "other": [], "sim": [], "room": []})

    task = F.pmod(F.xxhash64("label", "round", "code", "slice"), F.lit(max(1, nodes.count() * rounds // 4000)))
    return cells.withColumn("task", task).groupBy("task").applyInPandas(lambda f: compare(f), LISTS)


def trim(found: DataFrame, k: int, threshold: float, most: int) -> DataFrame:
    """Each node's list: its nearest, as many as it has room for. A list whose every entry is a link is saturated: its room doubles."""
    each = found.where("room > 0").groupBy("id", "other").agg(F.max("sim").alias("sim"), F.max("room").alias("room"))
    own = Window.partitionBy("id")
    ranked = each.withColumns({"room": F.max("room").over(own), "rank": F.row_number().over(own.orderBy(F.desc("sim"), "other"))}).where("rank <= room")
    full = F.count(F.lit(1)).over(own) >= F.col("room")
    return ranked.withColumn("room", F.when(full & (F.min("sim").over(own) >= threshold), F.least(F.col("room") * 2, F.lit(most))).otherwise(F.col("room"))).select("id", "other", "sim", "room")


def descend(nodes: DataFrame, lists: DataFrame, threshold: float, per_task: int, member_rows: int, deal: int) -> DataFrame:
    """One round of NN-descent: at every node its neighbours, both ways, are compared with one another (they are neighbours' neighbours).

    A node that is neighbour to very many has them dealt at random to parts of member_rows; each round (deal) deals anew.
    """
    both = lists.select(F.col("id").alias("at"), F.col("other").alias("id")).unionByName(lists.select(F.col("other").alias("at"), "id")).distinct()
    both = materialize(both)
    degree = materialize(both.groupBy("at").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))  # written, so that hubs can be split in the join
    room = lists.groupBy("id").agg(F.max("room").alias("room"))
    members = both.join(degree, "at").withColumn("part", F.pmod(F.xxhash64(F.lit(deal), "id"), F.ceil(F.col("n") / member_rows))).join(nodes.join(room, "id"), "id")
    task = F.pmod(F.xxhash64("at", "part"), F.lit(max(1, both.count() // per_task)))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        u, ids, rooms = _matrix(frame["vector"]), frame["id"].to_numpy(), frame["room"].to_numpy()
        out = []
        for rows in frame.groupby(["at", "part"]).indices.values():
            if len(rows) > 1:
                out.append(_nearest(ids[rows], u[rows], rooms[rows], threshold))
        found = pd.concat(out) if out else pd.DataFrame({"id": [], "other": [], "sim": [], "room": []})
        return found.sort_values(["id", "sim"], ascending=[True, False]).drop_duplicates(["id", "other", "room"])

    return members.select("at", "part", "id", "room", "vector").withColumn("task", task).groupBy("task").applyInPandas(lambda f: compare(f), LISTS)


def count_links(nodes: DataFrame, groups: DataFrame, threshold: float, block_rows: int, bin_rows: int) -> DataFrame:
    """id, links: the list of a saturated node enlarged to its whole component, as counts: every two members are compared once,
    in pairs of blocks, and only sums leave a task."""
    rows = blocks(materialize(sized(groups)).join(nodes.select("id", "copies"), "id"), block_rows, bin_rows).join(nodes.select("id", "vector"), "id")

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["component", "side_a", "side_b", "id"], ignore_index=True)
        u, ids, copies, block = _matrix(frame["vector"]), frame["id"].to_numpy(), frame["copies"].to_numpy(), frame["block"].to_numpy()
        side_a, side_b = frame["side_a"].to_numpy(), frame["side_b"].to_numpy()
        out_id, out_links = [], []
        for s, e in segments(frame):
            link = u[s:e] @ u[s:e].T >= threshold
            np.fill_diagonal(link, False)
            if side_a[s] != side_b[s]:
                link &= block[s:e, None] != block[None, s:e]
            out_id.append(ids[s:e]), out_links.append(link @ copies[s:e])
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64)
        return pd.DataFrame({"id": join(out_id), "links": join(out_links)})

    return rows.groupBy("task").applyInPandas(lambda f: count(f), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def audit(nodes: DataFrame, counts: DataFrame, threshold: float, sample: int, seed: int) -> tuple[int, int]:
    """(links found, links there), the latter by brute force against all nodes of their labels, of at most `sample` nodes of all and
    `sample` of those for which links were found (id, links): where links are rare, nodes drawn from all have none."""
    linked = few(counts.where("links > 0"), sample, "id", seed=seed).select("id")
    some = few(nodes.select("id"), sample, "id", seed=seed + 1).unionByName(linked).distinct()
    asked = nodes.join(F.broadcast(materialize(some)), "id").join(counts, "id", "left")  # 2 * sample rows at most
    asked = asked.select("id", "label", "vector", F.coalesce("links", F.lit(0)).alias("links")).collect()
    if not asked:
        return 0, 0
    u = _matrix(pd.Series([r["vector"] for r in asked]))
    ids, labels = np.array([r["id"] for r in asked]), np.array([r["label"] for r in asked])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = _matrix(batch["vector"])
            width = max(v.shape[1], u.shape[1])
            a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (u, v))
            link = (a @ b.T >= threshold) & (labels[:, None] == batch["label"].to_numpy()[None, :]) & (ids[:, None] != batch["id"].to_numpy()[None, :])
            yield pd.DataFrame({"n": [int((link @ batch["copies"].to_numpy()).sum())]})

    there = nodes.mapInPandas(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return sum(r["links"] for r in asked), there


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.98, k: int = 8, rounds: int = 2, leaf: int = 96, trees: int = 4, most: int = 64, target: float = 0.99, attempts: int = 6, sample: int = 512, seed: int = 13
) -> DataFrame:
    """Link vectors (vec_id, embedding, label) of one label with cosine >= threshold in doubles.

    Equal vectors of a label become one node. NN-descent starts from lists that random cells give and refines them by comparing
    neighbours' neighbours; lists full of links grow. Links form components. Inside each, every two nodes are then
    compared, which counts all links of saturated nodes. An audit measures the recall of links by brute force on at most `sample`
    nodes of all and as many of the linked ones; below the target, more trees and rounds follow, and after `attempts` of them
    RuntimeError.

    Returns a row a vector: vec_id, n_links (other vectors linked directly), component_id (least vec_id reachable), kept.
    Vectors that are null, zero or hold null or non-finite components, and rows with null label, link with nothing. Rows without vec_id
    take no part and are not returned. Rows that repeat a vec_id are vectors of their own; equal ones link. Other columns are ignored.
    An empty table gives no rows.
    """
    with_package(vectors.sparkSession)
    vector = F.transform("embedding", lambda x: x.cast("double"))
    fit = usable("embedding") & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull()
    base = vectors.where("vec_id is not null").select("vec_id", F.col("label").cast("long").alias("label"), F.when(F.coalesce(fit, F.lit(False)), vector).alias("vector"))
    key = lambda seed: F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(seed), "label", "vector"))
    base = base.withColumns({"key_a": key(1), "key_b": key(2)})
    return keep_last(vectors.sparkSession, lambda: _linked(base, threshold, k, rounds, leaf, trees, most, target, attempts, sample, seed))


def _linked(base: DataFrame, threshold: float, k: int, rounds: int, leaf: int, trees: int, most: int, target: float, attempts: int, sample: int, seed: int) -> DataFrame:
    """near_duplicates() of vec_id, label, vector (null if it links with nothing), key_a, key_b (which equal vectors of a label share)."""
    nodes = base.where("key_a is not null").groupBy("key_a", "key_b").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    nodes = numbered(nodes, "id")

    lists = forest = counts = groups = None
    for attempt in range(attempts):
        found = materialize(start_lists(nodes, k, leaf, trees, threshold, seed + attempt))
        forest = found.where("room = 0") if forest is None else forest.unionByName(found.where("room = 0"))
        lists = materialize(trim(found if lists is None else found.unionByName(lists), k, threshold, most))
        for r in range(rounds):
            found = materialize(descend(nodes, lists, threshold, 20_000, 256, deal=attempt * rounds + r))
            forest = forest.unionByName(found.where("room = 0"))
            lists = materialize(trim(found.unionByName(lists), k, threshold, most))
        groups = components(forest.select(F.col("id").alias("a"), F.col("other").alias("b")))
        counts = materialize(count_links(nodes, groups, threshold, 256, 2000))
        have, there = audit(nodes, counts, threshold, sample, seed)
        log.info("links found %s of %s in the audit", have, there)
        if have >= target * there:
            break
    else:
        raise RuntimeError(f"{have} of {there} links found in the audit, below the target of {target} after {attempts} attempts: ask for more")
    groups = materialize(groups)
    least = groups.join(nodes.select("id", "rep"), "id").groupBy("component").agg(F.min("rep").alias("component_id"))
    least = materialize(least)
    linked = nodes.select("id", "key_a", "key_b", "rep", "copies").join(groups.join(least, "component").select("id", "component_id"), "id", "left").join(counts, "id", "left")
    linked = linked.select("key_a", "key_b", F.coalesce("component_id", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = base.select("vec_id", "key_a", "key_b").join(materialize(linked), ["key_a", "key_b"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
