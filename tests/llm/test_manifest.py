"""The manifest against a tree that is built by hand, and what its proofs show."""

import hashlib
import zlib

import pytest

from presswire.llm import manifest

FAN = 8


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """(root, for each node the siblings on its way up as (before, after))."""
    at, paths = [[i] for i in range(len(nodes))], [[] for _ in nodes]
    while len(nodes) > 1:
        above, under = [], []
        for i in range(0, len(nodes), FAN):
            run = nodes[i : i + FAN]
            for j in range(len(run)):
                for x in at[i + j]:
                    paths[x].append((run[:j], run[j + 1 :]))
            above.append(h(*run))
            under.append([x for part in at[i : i + FAN] for x in part])
        nodes, at = above, under
    return nodes[0] if nodes else None, paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in order:
        own = sorted(groups[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        leaves = [leaf(r, r["text"]) for r in own]
        trees.append((own, leaves, *tree(leaves)))
    root, tops = tree([t[2] for t in trees])
    out = []
    for (own, leaves, subroot, paths), top in zip(trees, tops, strict=True):
        for r, x, path in zip(own, leaves, paths, strict=True):
            folded = x
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                folded = leaf(r, None if r["text"] is None else "".join(c.lower() if c.isascii() else c for c in r["text"]))
            for before, after in path + top:
                folded = h(*before, folded, *after)
            out.append((r["doc_id"], x, subroot, root, h(*[s for b, a in path + top for s in b + a]), folded, folded == root))
    return out


def check(docs):
    rows = [r.asDict() for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = [tuple(r) for r in manifest.manifest(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    return got


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 600])
def test_sizes(spark, n):
    """One group of n, and a lone leaf beside it from two rows on."""
    rows = [(i, f"Text {i} É", "en" if i else "de", "s", i) for i in range(n)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert n < 64 or {v for *_, v in got} == {True, False}


def test_many_groups(spark):
    """More groups than a run, so that there is a tree above the subroots; null and empty lang are two."""
    rows = [(i, "a" * (i % 5), None if i % 23 == 0 else "" if i % 23 == 1 else f"l{i % 23}é", None, None) for i in range(300)]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


def test_hot_group_of_equal_rows(spark):
    rows = [(7, "Same", "en", "s", 4)] * 150 + [(None, "Same", "en", "s", 4)] * 20 + [(i, "B", "en", "s", 1) for i in range(20)]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5))


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert manifest.manifest(no_docs).isEmpty()


def test_values_cannot_run_into_each_other(spark):
    """Lengths stand in front of values, and null is other than - and than empty."""
    rows = [(1, "ab", "c", "s", 1), (1, "b", "ca", "s", 1), (1, "", None, "s", 1), (1, None, None, "s", 1), (1, "-", None, "s", 1), (1, "1:x", "y", None, 1), (1, "x", "1:y", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert df.select(manifest.leaf().alias("x")).distinct().count() == len(rows)
