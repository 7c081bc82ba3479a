"""N-gram Jaccard join by chosen paths."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswire.llm.common import few, keep_last, materialize, numbered, with_package
from presswire.llm.graph import blocks, components, sized

POSITIONS = 128  # MinHash positions: the tokens of a set in the join's tree
log = logging.getLogger(__name__)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word shingles of each text as sorted 64-bit hashes, one text after the other, and their numbers.

    Words are runs of non-space, lower case. A text of fewer words than width has one shingle, all its words; a text
    without words has none.
    """
    words = [t.lower().split() for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    short = np.flatnonzero((n > 0) & (n < width))
    if not n.sum():
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    codes, unique = pd.factorize(np.array([w for ws in words for w in ws], dtype=object))
    h = pd.util.hash_array(np.asarray(unique, dtype=object), categorize=False).astype(np.uint64)[codes]
    start = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        total = np.zeros(len(h) - width + 1 if len(h) >= width else 0, dtype=np.uint64)
        for k in range(width):
            total = total * np.uint64(0x100000001B3) + _mix(h[k : k + len(total)] + np.uint64(k))
        per = np.maximum(n - width + 1, 0)
        at = np.repeat(start - (np.cumsum(per) - per), per) + np.arange(per.sum())
        value, owner = _mix(total[at]), np.repeat(np.arange(len(texts)), per)
        if len(short):
            extra = []
            for i in short:
                x = np.uint64(n[i])
                for k in range(n[i]):
                    x = x * np.uint64(0x100000001B3) + _mix(h[start[i] + k : start[i] + k + 1] + np.uint64(k + 101))[0]
                extra.append(x)
            value, owner = np.append(value, _mix(np.array(extra, dtype=np.uint64))), np.append(owner, short)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[fresh], np.bincount(owner[fresh], minlength=len(texts)).astype(np.int64)


def signatures(value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(sets, POSITIONS) MinHash values by one-permutation hashing; an empty position takes a value of a position it
    picks by a shared hash, so equal positions still come up with the sets' Jaccard similarity."""
    rows = np.repeat(np.arange(len(n)), n)
    empty = np.uint64(2**64 - 1)
    out = np.full((len(n), POSITIONS), empty, dtype=np.uint64)
    np.minimum.at(out, (rows, (value >> np.uint64(57)).astype(np.int64)), value & np.uint64(2**57 - 1))
    lacking, filled = np.nonzero((out == empty) & (n > 0)[:, None]), out.copy()
    todo, tries = np.stack(lacking), 0
    with np.errstate(over="ignore"):
        while todo.shape[1]:
            tries += 1
            pick = (_mix(todo[1].astype(np.uint64) * np.uint64(1009) + np.uint64(tries)) % np.uint64(POSITIONS)).astype(np.int64)
            got = out[todo[0], pick]
            ok = got != empty
            filled[todo[0][ok], todo[1][ok]] = _mix(got[ok] + np.uint64(tries))
            todo = todo[:, ~ok]
    return filled


def plan_roots(runs: int, threshold: float, seed: int) -> list[tuple[int, int]]:
    """(run, position): where the roots of the runs split the sets."""
    return [(run, int(p)) for run in range(runs) for p in _choices(run, 0, threshold, seed)]


def _choices(node: int, level: int, threshold: float, seed: int) -> np.ndarray:
    """Positions that a node of the tree splits on: 1 / threshold on average, at least one, the same wherever they are asked."""
    rng = np.random.default_rng([seed, level, node & (2**63 - 1)])
    n = 1 + int(rng.random() < 1 / threshold - 1)
    return rng.choice(POSITIONS, size=n, replace=False)


def describe(rows: DataFrame, roots: list[tuple[int, int]], width: int = 5) -> DataFrame:
    """row, doc_id, set_a, set_b (two hashes of the shingle set), n_shingles, sketch (POSITIONS x 16 bits), nodes (64 bits for each root split)."""
    with_package(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.iloc[lo : lo + 1000]
                value, n = shingle_hashes(part["text"].tolist(), width)
                sig = signatures(value, n)
                owner = np.repeat(np.arange(len(n)), n)
                with np.errstate(over="ignore"):
                    sums = np.zeros((2, len(n)), dtype=np.uint64)
                    np.add.at(sums[0], owner, value)
                    np.add.at(sums[1], owner, _mix(value + np.uint64(17)))
                    nodes = np.stack([_mix(_mix(sig[:, p] + np.uint64(p) * np.uint64(2**57)) + np.uint64(r + 1)) for r, p in roots], axis=1)
                small = sig.astype(np.uint16)
                yield pd.DataFrame(
                    {
                        "row": part["row"].to_numpy(), "doc_id": part["doc_id"].to_numpy(), "set_a": sums[0].astype(np.int64), "set_b": sums[1].astype(np.int64), "n_shingles": n,
                        "sketch": [x.tobytes() for x in small], "nodes": [x.tobytes() for x in nodes],
                    }
                )

    return rows.select("row", "doc_id", "text").mapInPandas(run, "row long, doc_id long, set_a long, set_b long, n_shingles long, sketch binary, nodes binary")


def _sketches(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint16).reshape(-1, POSITIONS)


def root_nodes(sets: DataFrame, roots: list[tuple[int, int]], runs: range) -> DataFrame:
    """node, run, id: each set in the child of each root split of these runs."""
    wanted = [(k, run) for k, (run, _) in enumerate(roots) if run in runs]

    def run_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes = np.frombuffer(b"".join(batch["nodes"]), dtype=np.int64).reshape(-1, len(roots))
            for k, run in wanted:
                yield pd.DataFrame({"node": nodes[:, k], "run": run, "id": batch["id"].to_numpy()})

    return sets.select("id", "nodes").mapInPandas(run_all, "node long, run int, id long")


def split_nodes(rows: DataFrame, level: int, threshold: float, seed: int) -> DataFrame:
    """The children of nodes that are too large: node, run, id, sketch -> node, run, id."""

    def run_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sig = _sketches(batch["sketch"])
            nodes, index = np.unique(batch["node"].to_numpy(), return_inverse=True)
            picks = [_choices(int(x), level, threshold, seed) for x in nodes]
            for k in range(max((len(p) for p in picks), default=0)):
                at = np.array([p[k] if k < len(p) else -1 for p in picks])[index]
                ok = np.flatnonzero(at >= 0)
                with np.errstate(over="ignore"):
                    value = _mix(sig[ok, at[ok]].astype(np.uint64) + at[ok].astype(np.uint64) * np.uint64(2**32))
                    node = _mix(value + batch["node"].to_numpy()[ok].astype(np.uint64))
                yield pd.DataFrame({"node": node.astype(np.int64), "run": batch["run"].to_numpy()[ok], "id": batch["id"].to_numpy()[ok]})

    return rows.select("node", "run", "id", "sketch").mapInPandas(run_all, "node long, run int, id long")


def spanning(links: np.ndarray) -> np.ndarray:
    """The smallest row that each row of a symmetric boolean matrix can reach."""
    n = len(links)
    label, reach = np.arange(n), links | np.eye(n, dtype=bool)
    while True:
        new = np.where(reach, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def likely(rows: DataFrame, floor: float) -> DataFrame:
    """Edges a, b, run between the sets that meet in a task, judged by sketches: a spanning forest, not all pairs.

    rows: blocks() of nodes (component: the node), with run and sketch.
    """

    def run_all(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["component", "side_a", "side_b", "id"], ignore_index=True)
        sig, ids, run = _sketches(frame["sketch"]), frame["id"].to_numpy(), frame["run"].to_numpy()
        a, b, r = [], [], []
        for s, e in segments(frame):
            if e - s == 2:
                label = np.array([0, 0 if (sig[s] == sig[s + 1]).mean() >= floor else 1])
            else:
                part = sig[s:e]
                label = spanning(np.stack([(part == x).mean(axis=1) for x in part]) >= floor)
            other = np.flatnonzero(label != np.arange(e - s))
            a.append(ids[s + label[other]]), b.append(ids[s + other]), r.append(run[s + other])
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, dtype=t)
        return pd.DataFrame({"a": join(a, np.int64), "b": join(b, np.int64), "run": join(r, np.int32)})

    return rows.groupBy("task").applyInPandas(lambda f: run_all(f), "a long, b long, run int")


def segments(frame: pd.DataFrame) -> list[tuple[int, int]]:
    """Ranges of two rows or more with one component and pair of blocks, in a frame sorted by these."""
    key = frame[["component", "side_a", "side_b"]].to_numpy()
    starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))) if len(key) else np.zeros(0, dtype=int)
    return [(s, e) for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True) if e - s > 1]


def candidates(sets: DataFrame, roots: list[tuple[int, int]], runs: range, small: int, threshold: float, levels: int, seed: int, floor: float) -> DataFrame:
    """a, b, run: edges that join the sets which these runs bring together and which are likely at the floor, as spanning forests.

    Nodes of up to `small` sets are compared by brute force; larger ones are split further; what is still larger after
    `levels` splits, as groups of near copies are, is compared in pairs of blocks.
    """
    nodes, edges = root_nodes(sets, roots, runs), None
    for level in range(1, levels + 1):
        nodes = materialize(nodes)
        shared = materialize(sized(nodes.withColumnRenamed("node", "component")).where("members > 1"))
        last = level == levels
        dealt = blocks(shared if last else shared.where(F.col("members") <= small), small, 2000)
        found = likely(dealt.join(sets.select("id", "sketch"), "id"), floor)
        edges = materialize(found if edges is None else edges.unionByName(found))
        large = shared.where(F.col("members") > small).withColumnRenamed("component", "node")
        if last or large.isEmpty():
            break
        nodes = split_nodes(large.join(sets.select("id", "sketch"), "id"), level, threshold, seed)
    return edges


def grouped(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components (id, component) of all edges, and of those of even and of odd runs alone (half 1 and 2), found in one go."""
    pairs = materialize(edges.groupBy("a", "b").agg(F.max(F.col("run") % 2 == 0).alias("even"), F.max(F.col("run") % 2 == 1).alias("odd")))
    tag = lambda rows, half: rows.select((F.col("a") * 4 + half).alias("a"), (F.col("b") * 4 + half).alias("b"))
    stars = materialize(components(tag(pairs, 0).unionByName(tag(pairs.where("even"), 1)).unionByName(tag(pairs.where("odd"), 2))))
    apart = stars.select(F.shiftright("id", 2).alias("id"), F.shiftright("component", 2).alias("component"), F.pmod("id", F.lit(4)).cast("int").alias("half"))
    return apart.where("half = 0").select("id", "component"), apart.where("half > 0")


def captured(links: DataFrame, halves: DataFrame) -> tuple[int, int, int, int]:
    """Of links (a, b) that were found exactly: their number, and of how many both ends are in one component of even runs, of odd runs, of both."""
    ends = links.select("a", "b", F.explode(F.array("a", "b")).alias("id")).join(halves, "id")
    met = ends.groupBy("a", "b", "half").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("n = 2 and lo = hi")
    each = met.groupBy("a", "b").agg(F.max((F.col("half") == 1).cast("int")).alias("x"), F.max((F.col("half") == 2).cast("int")).alias("y"))
    x, y, both = each.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("x"), F.col("y"), F.col("x") * F.col("y"))]).first()
    return links.count(), x, y, both


def overlaps(value: np.ndarray, n: np.ndarray, columns: int = 16384) -> np.ndarray:
    """Numbers of common hashes of every two sets (sorted hashes, one set after the other; n: their sizes)."""
    if len(n) == 2:
        both = len(np.intersect1d(value[: n[0]], value[n[0] :], assume_unique=True))
        return np.array([[n[0], both], [both, n[1]]])
    row = np.repeat(np.arange(len(n)), n)
    _, col, times = np.unique(value, return_inverse=True, return_counts=True)
    shared = times > 1
    slot = np.cumsum(shared) - 1
    ok = shared[col]
    row, col = row[ok], slot[col[ok]]
    out = np.zeros((len(n), len(n)))
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, int(shared.sum()), columns):
        s, e = np.searchsorted(col, [lo, lo + columns])
        m = np.zeros((len(n), columns), dtype=np.float32)
        m[row[s:e], col[s:e] - lo] = 1
        out += m @ m.T
    np.fill_diagonal(out, n)
    return out.astype(np.int64)


def verify(rows: DataFrame, threshold: float, width: int) -> DataFrame:
    """Exact links of the sets that meet in a task. rows: blocks() with copies and the text of one row of each set.

    id, other, links: a row with links for each set and pair of blocks (copies of the other sets linked), and rows with
    other for a spanning forest of the links. Each pair of sets is judged in one task.
    """

    def run_all(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["component", "side_a", "side_b", "id"], ignore_index=True)
        ids, copies, block = frame["id"].to_numpy(), frame["copies"].to_numpy(), frame["block"].to_numpy()
        out_id, out_other, out_links = [], [], []
        for s, e in segments(frame):
            at, texts = np.arange(s, e), frame["text"].iloc[s:e].tolist()
            value, n = shingle_hashes(texts, width)
            both = overlaps(value, n)
            link = both >= threshold * (n[:, None] + n[None, :] - both) - 1e-9
            np.fill_diagonal(link, False)
            if frame["side_a"].iloc[s] != frame["side_b"].iloc[s]:
                link &= block[at][:, None] != block[at][None, :]
            links = link @ copies[at]
            has = np.flatnonzero(links)
            label = spanning(link)
            other = np.flatnonzero(label != np.arange(len(at)))
            out_id += [ids[at[has]], ids[at[other]]]
            out_other += [np.full(len(has), -1), ids[at[label[other]]]]
            out_links += [links[has], np.full(len(other), -1)]
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64)
        return pd.DataFrame({"id": join(out_id), "other": join(out_other), "links": join(out_links)})

    return rows.groupBy("task").applyInPandas(lambda f: run_all(f), "id long, other long, links long")


def join_rows(
    rows: DataFrame, threshold: float = 0.8, width: int = 5, target: float = 0.995, batch_runs: int = 8, batches: int = 4, small: int = 128, levels: int = 4, floor: float | None = None, seed: int = 5
) -> DataFrame:
    """join_documents() for numbered() rows (row, doc_id, text) without nulls: the same columns, and row.

    Raises RuntimeError if the estimated recall is below the target after all batches of runs.
    """
    floor = threshold - 0.15 if floor is None else floor
    roots = plan_roots(batch_runs * batches, threshold, seed)
    described = materialize(describe(rows, roots, width))
    one = F.min(F.struct("doc_id", "row")).alias("rep")
    sets = described.where("n_shingles > 0").groupBy("set_a", "set_b").agg(one, F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"), F.first("nodes").alias("nodes"))
    sets = numbered(sets, "id")

    edges = found = None
    for batch in range(batches):
        new = candidates(sets, roots, range(batch * batch_runs, (batch + 1) * batch_runs), small, threshold, levels, seed, floor)
        edges = new if edges is None else edges.unionByName(new)
        groups, halves = grouped(edges)
        plan = blocks(materialize(sized(groups)).join(sets.select("id", "copies", F.col("rep.row").alias("row")), "id"), small, 256)
        found = materialize(verify(rows.select("row", "text").join(plan.hint("shuffle_hash"), "row"), threshold, width))
        sample = few(found.where("other <> -1").select(F.col("id").alias("a"), F.col("other").alias("b")), 100_000, "a", "b")
        links, x, y, both = captured(materialize(sample), halves)
        missed = (1 - both / y) * (1 - both / x) if x and y else float(links > 0)
        log.info("links %d, of even runs %d, of odd runs %d, of both %d: estimated recall %.4f", links, x, y, both, 1 - missed)
        if missed <= 1 - target:
            break
    else:
        raise RuntimeError(f"estimated recall of links {1 - missed:.4f} is below {target} after {batches * batch_runs} runs: ask for more batches")

    linked = components(found.where("other <> -1").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.where("other = -1").groupBy("id").agg(F.sum("links").alias("links"))
    least = linked.join(sets.select("id", "rep"), "id").groupBy("component").agg(F.min("rep").alias("least"))
    classes = sets.select("id", "set_a", "set_b", "rep", "copies").join(linked.join(least, "component").select("id", "least"), "id", "left").join(counts, "id", "left")
    classes = classes.select("set_a", "set_b", F.col("rep.doc_id").alias("class_id"), F.coalesce("least", "rep").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # Classes are written first: the join with the documents is then one whose hot classes adaptive execution can split.
    out = described.select("row", "doc_id", "set_a", "set_b", "n_shingles").join(materialize(classes), ["set_a", "set_b"], "left")
    own = F.col("n_shingles") == 0
    return out.select(
        "row",
        "doc_id",
        F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(own, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
        F.when(own, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        "n_shingles",
        (own | (F.col("row") == F.col("least.row"))).alias("kept"),
    )


def join_documents(docs: DataFrame, **options) -> DataFrame:
    """Link documents (doc_id, text) whose word shingle sets have Jaccard similarity >= threshold.

    1. Each text becomes its set's two hashes, MinHash sketch and places in the tree; equal sets become one class.
    2. Chosen paths (candidates()) gather classes into loose groups by sketches that are likely at a lower similarity.
    3. Inside each group every two classes are compared exactly on their whole texts, in pairs of bounded blocks.
    So a link is never wrong, and one is missed only if no run brought a path between its two classes. A run brings two sets of
    similarity 0.8 together with a chance of about 0.57 after four splits, more after fewer, so a batch of 8 runs misses some one in 900. How many links
    even and odd runs found each by themselves estimates that on (at most 100,000 of) the links found; batches of runs repeat until the estimate reaches the
    target, and if it never does the join raises RuntimeError. options: see join_rows().

    Returns a row a document: doc_id, class_id (least doc_id with the same shingle set), component_id (least doc_id reachable
    by links), n_links (other rows linked directly), n_shingles, kept (true for one row of each component: of least doc_id).
    Null and empty texts have no shingles: they link with nothing and are classes of their own, all kept. Texts of fewer words than
    width have one shingle. Rows without doc_id take no part and are not returned. Rows that repeat a doc_id are documents of their own:
    equal texts are one class, other texts are judged by themselves. Other columns are ignored. An empty table gives no rows.
    """
    some = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    return keep_last(docs.sparkSession, lambda: join_rows(numbered(some, "row"), **options).drop("row"))
