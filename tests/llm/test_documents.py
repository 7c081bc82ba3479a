"""Operators over documents: brute force at small size, planted cases, and odd input."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from presswire.llm import common, jaccard, mixing, packing, sharding, suffixes, toxicity
from presswire.llm.common import table


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]


# --- what operators share


def test_equal_rows_are_numbered_in_every_part(spark):
    rows = [(i % 3 if i < 40 else i, None if i % 2 else "t") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    key_a, key_b = common.row_keys(["doc_id", "text"])
    got = common.with_nth(common.numbered(df.withColumns({"key_a": key_a, "key_b": key_b}), "row"), "row").collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"], r["text"]].append(r["nth"])
    assert Counter(rows) == Counter({k: len(v) for k, v in by.items()}) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) > 5


def test_row_keys_tell_nulls_from_values(spark):
    df = spark.createDataFrame([("x", None), (None, "x"), ("x", "x"), (None, None), ("", None), (None, "")], "a string, b string")
    assert df.select(*common.row_keys(["a", "b"])).distinct().count() == 6


def test_few_is_bounded_and_the_same_in_every_run(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    got = {r["k"] for r in common.few(df, 20, "k").collect()}
    assert len(got) == 20 and got == {r["k"] for r in common.few(df.repartition(7), 20, "k").collect()}
    assert common.few(df.limit(5), 20, "k").count() == 5 and common.few(df.limit(0), 20, "k").count() == 0
    assert common.few(spark.createDataFrame([(1,)] * 50, "k long"), 20, "k").count() == 1


# --- toxicity


def test_toxicity_on_held_out_documents(spark, docs, sf_dir):
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).withColumn("held_out", toxicity.is_held_out()).join(labels, "doc_id").toPandas()
    assert all(got["held_out"] == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got["doc_id"]])
    held = got[got["held_out"]]
    said = held["score"] >= 0.3
    assert (said & (held["toxic"] == 0)).sum() <= 0.02 * len(held)
    assert (said & (held["toxic"] == 1)).sum() >= 0.6 * held["toxic"].sum()


def test_toxicity_ignores_held_out_labels(spark):
    docs = spark.createDataFrame([(i, "bad slur word" if i % 2 else "fine calm word") for i in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (docs.doc_id % 2).cast("int").alias("toxic")).where(toxicity.is_held_out())
    assert toxicity.fit(docs, labels).empty


def test_toxic_spans_point_at_the_words(spark):
    texts = [("You slur, really", 1), ("calm words  only", 0)]
    docs = spark.createDataFrame([(i, texts[i % 2][0] + f" n{i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, texts[i % 2][1]) for i in range(200)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).orderBy("doc_id").limit(2).collect()
    assert {texts[0][0][s["start"] : s["end"]] for s in got[0]["spans"]} >= {"slur,"} and not got[1]["spans"]
    assert got[0]["score"] > 0.7 > 0.3 > got[1]["score"]


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    emit, trans = rng.normal(size=(1, 5)), rng.normal(size=(2, 2))
    weight = {}
    for path in np.ndindex(*[2] * 5):
        score = sum(emit[0, t] * s for t, s in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:]))
        weight[path] = np.exp(score)
    total = sum(weight.values())
    p, pair, log_z = toxicity.forward_backward(emit, np.ones((1, 5), dtype=bool), trans)
    assert np.allclose(p[0], [sum(w for k, w in weight.items() if k[t]) / total for t in range(5)])
    assert np.isclose(log_z[0], np.log(total))
    assert np.allclose(pair, [[sum(w * sum(k[t] == a and k[t + 1] == b for t in range(4)) for k, w in weight.items()) / total for b in range(2)] for a in range(2)])


def test_document_score_against_enumeration(spark):
    """The score of a short text, from the weights of all its paths."""
    rng = np.random.default_rng(3)
    tagger = toxicity.Tagger(ids={"wbad": 0, "4slur": 1, "wrude": 2}, weights=np.array([2.0, 1.5, 0.7]), extra=np.array([-2.0, 0.4, 0.3]), trans=rng.normal(size=(2, 2)), document=np.array([0.8, 1.1, 0.5, -2.0]), empty=False)
    texts = ["Bad slurry day", "rude bad! bad fine", "fine", "one two three four five", ""]
    got = [r["score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tagger).orderBy("doc_id").collect()]
    for text, score in zip(texts, got, strict=True):
        tokens = text.lower().split()
        own = [tagger.listed(t) for t in tokens]
        emit = [tagger.weights[f].sum() + tagger.extra[0] + (tagger.extra[1] if i and own[i - 1] else 0) + (tagger.extra[2] if i + 1 < len(own) and own[i + 1] else 0) for i, f in enumerate(own)]
        weight = {path: np.exp(sum(e * s for e, s in zip(emit, path)) + sum(tagger.trans[a, b] for a, b in zip(path, path[1:]))) for path in np.ndindex(*[2] * len(tokens))}
        p = np.array([sum(w for k, w in weight.items() if k[t]) / sum(weight.values()) for t in range(len(tokens))])
        x = [-np.log1p(-p).sum(), p.max(initial=0), np.log1p(p[p > 0.05].sum())]
        assert np.isclose(score, 1 / (1 + np.exp(-(np.array(x) @ tagger.document[:3] + tagger.document[3]))))


def test_relabelling_follows_the_marginals():
    p = np.array([[0.1, 0.6, 0.2], [0.9, 0.8, 0.1], [0.1, 0.3, 0.2], [0.1, 0.2, 0.7]])
    assert toxicity.relabel(p, np.array([0, -1, 1, 1]), likely=0.5).tolist() == [[0, 1, 0], [0, 0, 0], [0, 1, 0], [0, 0, 1]]


def test_fits_agree_whatever_the_order_and_the_repeats(spark):
    texts = ["you slur person", "calm words here", "slur again you", "more calm talk"]
    rows = [(i, texts[i % 4] + f" n{i % 40}") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 in (0, 2))) for i in range(200)] + [(0, 0), (4, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a = toxicity.fit(docs, labels)
    b = toxicity.fit(docs.unionByName(docs).repartition(9), labels)
    assert list(a.ids) == list(b.ids) and np.allclose(a.weights, b.weights) and np.allclose(a.document, b.document)


def test_toxicity_odd_input(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 1), (4, 0), (9, 1), (6, 0), (9, 1)], "doc_id long, toxic int")
    got = toxicity.score(odd_docs, toxicity.fit(odd_docs, labels)).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(no_docs, toxicity.fit(no_docs, labels)).count() == 0
    assert toxicity.drop_toxic(odd_docs, toxicity.Tagger()).count() == odd_docs.count()


# --- n-gram Jaccard join


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_links(pairs, threshold=0.8):
    sets = [(d, shingles(t)) for d, t in pairs]
    links, root = Counter(), {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {d: (links[d], find(d)) for d, _ in sets}


def jaccard_result(df, **options):
    return {r["doc_id"]: (r["n_links"], r["component_id"]) for r in jaccard.join_documents(df, **options).collect()}


def test_jaccard_against_brute_force(docs, rows):
    assert jaccard_result(docs) == brute_links([(d, t) for d, t, _ in rows])


def test_jaccard_dense_group_in_blocks(spark):
    """Near copies in one chain-like group, larger than the blocks, with small nodes and few levels."""
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(90):
        words = list(base)
        for k in rng.integers(200, size=3):
            words[k] = f"x{i}-{k}"
        texts.append((i, " ".join(words)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert jaccard_result(df, small=8, levels=2) == brute_links(texts)


def test_jaccard_odd_input(odd_docs, no_docs):
    got = jaccard.join_documents(odd_docs).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["n_links"], r["component_id"], r["kept"]))
    assert len(got) == odd_docs.count() - 1  # the row without id
    assert by[3] == [(1, 3, True)] and by[4] == [(1, 3, False)] and sorted(by[5]) == [(1, 5, False), (1, 5, True)]
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[8] == [(0, 8, True)]
    assert jaccard.join_documents(no_docs).count() == 0


def test_jaccard_repeated_rows_with_near_copies(spark):
    words = [f"w{i}" for i in range(100)]
    near, far = " ".join([*words[:-1], "other"]), " ".join(f"v{i}" for i in range(100))
    rows = [(5, " ".join(words)), (5, " ".join(words)), (10, near), (5, far), (20, " ".join([*far.split()[:-1], "x"])), (30, "alone " * 9)]
    got = [tuple(r) for r in jaccard.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_links", "n_shingles", "component_id").collect()]
    assert sorted(got) == [(5, 1, 96, 5), (5, 2, 96, 5), (5, 2, 96, 5), (10, 2, 96, 5), (20, 1, 96, 5), (30, 0, 1, 30)]


def test_jaccard_keeps_one_row_a_component_and_judges_each_row(spark):
    """One id on many texts, each with a near copy; a text on many rows of one id."""
    words = lambda k: [f"{k}-{i}" for i in range(60)]
    rows = [(7, " ".join(words(k))) for k in range(6)] + [(100 + k, " ".join([*words(k)[:-1], "end"])) for k in range(6)] + [(7, " ".join(words(0)))] * 20
    got = jaccard.join_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).toPandas()
    assert len(got) == len(rows) and (got["component_id"] == 7).all() and got["kept"].sum() == 6
    assert sorted(got["n_links"]) == [1] * 10 + [21] * 22
    assert (got[got["doc_id"] != 7]["kept"] == False).all()  # noqa: E712


def test_jaccard_reports_a_recall_below_the_target(spark, docs):
    with pytest.raises(RuntimeError, match="recall"):
        jaccard.join_documents(docs, target=1.1, batches=1).count()
    halves = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 3, 1), (5, 5, 2), (6, 6, 2)], "id long, component long, half int")
    links = spark.createDataFrame([(1, 2), (3, 4), (5, 6), (7, 8)], "a long, b long")
    assert jaccard.captured(links, halves) == (4, 2, 1, 1)


# --- suffix-array dedup


def brute_cut(pairs, least=50):
    first, out = {}, {}
    for d, t in sorted(pairs):
        data = t.encode()
        cover = np.zeros(len(data), dtype=bool)
        for p in range(len(data) - least + 1):
            if first.setdefault(data[p : p + least], d) < d:
                cover[p : p + least] = True
        kept = bytes(np.frombuffer(data, dtype=np.uint8)[~cover])
        runs = int((cover & ~np.append(False, cover[:-1])).sum()) if len(data) else 0
        out[d] = (len(data), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def cut_result(df, **options):
    return {r["doc_id"]: tuple(r)[1:] for r in suffixes.dedup(df, **options).collect()}


def test_suffixes_against_brute_force(docs, rows):
    assert cut_result(docs) == brute_cut([(d, t) for d, t, _ in rows])


def test_suffixes_planted(spark):
    """Repeats at edges, overlapping ones, periodic texts, and repeats inside one document, which stay."""
    rng = np.random.default_rng(5)
    noise = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    p, q = noise(70), noise(50)
    texts = [p + noise(40), noise(9) + p + q, q + p[:49], q[1:] + noise(30) + p[10:65], "ab" * 60, "ba" * 40, noise(60) * 3, "x" * 49, "x" * 50, "y" * 130, "y" * 51 + q, p[20:] + q[:30] + p[20:] + q]
    pairs = list(enumerate(texts))
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    assert cut_result(df) == brute_cut(pairs)
    assert cut_result(df.repartition(5)) == brute_cut(pairs)
    grain = suffixes.Grain(least=24, anchor=7)
    assert cut_result(df, grain=grain) == brute_cut(pairs, 24)


def test_suffixes_hot_anchors_are_spread(spark):
    rng = np.random.default_rng(4)
    own = lambda k: "".join(map(chr, rng.integers(97, 123, k)))
    passage = own(40)
    texts = [(i, own(60) + passage + own(60) + (own(55) if i % 3 else f"{'copied tail ' * 6}")) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted(map(tuple, suffixes.dedup(docs, suffixes.Grain(hot=3)).collect()))
    assert got == sorted(map(tuple, suffixes.dedup(docs).collect())) and sum(r[2] for r in got) > 1000
    ids, data = np.arange(60), [t.encode() for _, t in texts]
    keys = {b: r for f in suffixes.key_rows(ids, data, suffixes.Grain(), 7) for b, k, r in f.itertuples(index=False) if k == suffixes.KEYS}
    back = [d for b, r in keys.items() for d in suffixes.shared_keys([r], 7, b, 3)["data"]]
    sent = [r for f in suffixes.context_rows(ids, data, back, suffixes.Grain(), 7) for r in f.itertuples(index=False)]
    assert len({r.task for r in sent if r.kind == suffixes.WINDOWS}) == 7 and not any(r.kind == suffixes.CONTEXTS and len(suffixes.unpack(r.data)[0][0]) > 30 for r in sent)


def test_suffixes_anchors_that_a_batch_shows_to_be_hot(spark):
    """Anchors of more than two contexts in a batch go by window in every batch, also where few have them."""
    rng = np.random.default_rng(6)
    own = lambda k: "".join(map(chr, rng.integers(97, 123, k)))
    passage = own(45)
    pairs = [(i, own(60) + passage + own(60) + (own(55) if i % 3 else "copied tail " * 6)) for i in range(60)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    for df in (docs, docs.repartition(4), docs.orderBy("doc_id").repartitionByRange(2, F.pow("doc_id", F.lit(0.1)))):
        assert cut_result(df, grain=suffixes.Grain(often=2)) == brute_cut(pairs)


def test_suffixes_of_rows_that_repeat_a_doc_id(spark):
    """Rows of one doc_id cover nothing in each other, and each is cut at its own places."""
    rng = np.random.default_rng(7)
    own = lambda k: "".join(map(chr, rng.integers(97, 123, k)))
    p, q = own(70), own(80)
    rows = [(1, p + own(30)), (1, q + own(10)), (5, own(40) + p + own(20)), (5, own(90) + q), (5, own(300)), (5, own(40) + p), (9, q + p), (5, "z" + q)]
    rows += [rows[2]] * 3
    got = Counter(tuple(r)[1:] for r in suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = Counter()
    for d, t in rows:
        data = t.encode()
        earlier = {e.encode()[i : i + 50] for c, e in rows if c < d for i in range(len(e) - 49)}
        cover = np.zeros(len(data), dtype=bool)
        for i in range(len(data) - 49):
            cover[i : i + 50] |= data[i : i + 50] in earlier
        kept = bytes(np.frombuffer(data, dtype=np.uint8)[~cover])
        want[len(data), int(cover.sum()), int((cover & ~np.append(False, cover[:-1])).sum()), hashlib.sha256(kept).hexdigest()] += 1
    assert got == want


def test_suffixes_by_windows_against_brute_force(docs, rows):
    want = sorted(map(tuple, suffixes.dedup(docs).collect()))
    assert sorted(map(tuple, suffixes.dedup(docs, suffixes.Grain(hot=0)).collect())) == want


def test_maximal_repeats_against_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(20):
        s = "".join(rng.choice(list("ab"), 14))
        order = sorted(range(len(s)), key=lambda i: s[i:])
        common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        lcp = np.array([0] + [common(s[i:], s[j:]) for i, j in zip(order, order[1:])])
        left = np.array([ord(s[i - 1]) if i else -1 for i in order])
        got = {(s[order[a] : order[a] + n], tuple(sorted(order[a : b + 1]))) for n, a, b in suffixes.maximal_repeats(lcp, left, 2)}
        want = set()
        for n in range(2, len(s)):
            for sub in {s[i : i + n] for i in range(len(s) - n + 1)}:
                at = tuple(i for i in range(len(s)) if s.startswith(sub, i))
                before, after = {s[i - 1] if i else "^" for i in at}, {s[i + n] if i + n < len(s) else f"${i}" for i in at}
                if len(at) > 1 and len(before) > 1 and len(after) > 1:
                    want.add((sub, at))
        assert got == want


def test_suffixes_odd_input(odd_docs, no_docs):
    got = suffixes.dedup(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[4]["n_removed"] == by[4]["n_bytes"] and by[4]["n_spans"] == 1 and by[3]["n_removed"] == 0
    assert by[1]["n_bytes"] == by[2]["n_bytes"] == 0 and by[5]["n_removed"] == 0 and by[None]["n_removed"] == 0
    cut = suffixes.cut_repeats(odd_docs)
    assert cut.columns == odd_docs.columns and cut.schema == odd_docs.schema
    after = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert after[4] == "" and after[1] is None and after[7].startswith("ünï")
    assert suffixes.dedup(no_docs).count() == 0 and suffixes.cut_repeats(no_docs).count() == 0


# --- mixing


def test_targets_share_what_caps_free():
    assert mixing.source_targets({"a": 10, "b": 10, None: 100}) == {"a": 20.0, "b": 20.0, None: 140.0}
    got = mixing.source_targets({"b": 30, "a": 100, "c": 5, None: 50})
    assert list(got) == ["a", "b", "c", None] and abs(sum(got.values()) - 1.5 * 185) < 1e-9
    assert all(got[s] <= 2 * n + 1e-9 for s, n in {"b": 30, "a": 100, "c": 5, None: 50}.items())
    assert mixing.source_targets({}) == {} and mixing.source_targets({"a": 0}) == {"a": 0.0}


def test_split_quotas_keeps_every_block():
    got = mixing.split_quotas([1000, 37, 0, 5], 7, 3)
    assert got.sum(axis=0).tolist() == [1000, 37, 0, 5] and (got >= 0).all()
    assert got.sum(axis=1).max() - got.sum(axis=1).min() <= 3
    assert (got == mixing.split_quotas([1000, 37, 0, 5], 7, 3)).all()


def test_mix(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got, again = (mixing.mix(d).orderBy("doc_id").toPandas() for d in (docs, docs.repartition(7)))
    assert (got[["doc_id", "taken"]] == again[["doc_id", "taken"]]).all(axis=None)
    size = {r[0]: len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", r[1]) if w]) for r in docs.select("doc_id", "text").collect()}
    assert dict(zip(got["doc_id"], got["size"])) == size
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] == got["size"] * got["copies"].map(len)).all()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((by["taken"] - by["target"]).abs() <= by["most"] / 2 + 1).all()


def brute_taken(df):
    """What mix() takes, one source after the other: rows in the order of their hashes, up to the target."""
    key_a, key_b = common.row_keys(["doc_id", "source", "text"])
    rows = common.with_nth(common.numbered(df.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).alias("size"), key_a.alias("key_a"), key_b.alias("key_b")), "row"), "row")
    rows = rows.select("*", common.bucket(1024, "key_a", "nth", seed=11).alias("b"), common.bucket(1024, "key_a", "nth", seed=12).alias("s")).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    targets, out = mixing.source_targets(sizes), Counter()
    for source, target in targets.items():
        passes = min(2, int(target // sizes[source])) if sizes[source] else 0
        rest, before = target - passes * sizes[source], 0
        for r in sorted((r for r in rows if r["source"] == source), key=lambda r: (r["b"], r["s"], r["key_a"], r["nth"])):
            out[r["doc_id"], r["size"], sizes[source], target, r["size"] * (passes + (before + r["size"] / 2 <= rest))] += 1
            before += r["size"]
    return out


def mixed(df):
    return Counter((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.mix(df).collect())


def test_mix_against_brute_force(docs, odd_docs):
    assert mixed(docs) == brute_taken(docs) and mixed(odd_docs) == brute_taken(odd_docs)


def test_mix_of_a_source_with_one_id(spark):
    """One doc_id on all rows of a source, with equal and with other texts, and no ids at all: targets are met, reruns agree."""
    rows = [(7, f"w{i} " * 5, "a") for i in range(100)] + [(8, "same five words of text", "b")] * 900 + [(None, f"null {i} id", "c") for i in range(300)] + [(i, "x y z " * 4, None) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas()
    for _, part in got.groupby("source", dropna=False):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 5 and (part["taken"] <= 2 * part["size"]).all()
    assert mixed(df) == mixed(df.repartition(7)) == brute_taken(df)


def test_mix_odd_input(odd_docs, no_docs):
    got = mixing.mix(odd_docs).collect()
    assert len(got) == odd_docs.count() and sum(r["size"] for r in got) > 60_000
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(no_docs).count() == 0


# --- packing


def check_packing(pieces, ids, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for d, parts in by_doc.items():
        parts.sort(key=lambda r: r["piece"])
        at = 0
        for i, r in enumerate(parts):
            assert (r["piece"], r["start"]) == (i, at)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[d][at : at + r["length"]], dtype="<u4").tobytes())
            assert i == 0 or r["length"] == capacity
            at += r["length"]
        assert at == len(ids[d])
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == np.cumsum([0, *[r["length"] for r in parts]])[:-1].tolist() and sum(r["length"] for r in parts) <= capacity
    return len(by_sequence)


def test_packing_ids_and_bound(docs, rows, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    ids = {d: [*t.encode(x, add_special_tokens=False).ids, 0] for d, x, _ in rows}
    n = check_packing(packing.pack(docs, tokenizer).collect(), ids, 2048)
    assert n <= 1.01 * sum(map(len, ids.values())) / 2048 + 1


def test_fast_ids_equal_the_library(odd_docs, tokenizer):
    from tokenizers import Tokenizer

    t, encode = Tokenizer.from_file(tokenizer), packing.encoder(tokenizer)
    texts = [r["text"] or "" for r in odd_docs.collect()] + ["  a\n\n b\t c", "it's we're 'LL", "\u0000​٣٤", "<|endoftext|>", "x<|endoftext|>y", "ﬁ ñ 한국어 日本", "a" * 3000, "\r\n \r\n"]
    assert [encode(x) for x in texts] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_local_search_empties_bins():
    lengths = np.array([6, 4, 7, 3, 5, 5, 2, 8])
    worst = [[0], [1], [2], [3], [4], [5], [6], [7]]
    got = packing.empty_bins(worst, lengths, 10)
    assert sorted(i for b in got for i in b) == list(range(8)) and len(got) == 4
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 100, 300)
    best = packing.best_fit(lengths, 100)
    got = packing.empty_bins(best, lengths, 100)
    assert len(got) <= len(best) and sorted(i for b in got for i in b) == list(range(300)) and max(lengths[b].sum() for b in got) <= 100


def test_swaps_beat_best_fit():
    """Best fit decreasing leaves three bins here; one exchange makes two."""
    lengths = np.array([5, 4, 4, 3, 2, 2])
    start = [[0, 1], [2, 3, 4], [5]]
    assert len(packing.empty_bins(start, lengths, 10)) == 2


def test_other_tokenizer_files_take_no_fast_path(tmp_path, tokenizer):
    import json

    from tokenizers import Tokenizer

    spec = json.loads(open(tokenizer, encoding="utf-8").read())
    assert packing.is_fast(spec)
    spec["normalizer"] = {"type": "Lowercase"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    assert not packing.is_fast(spec) and packing.encoder(str(path))("ABC def") == Tokenizer.from_file(str(path)).encode("abc def", add_special_tokens=False).ids
    assert not packing.is_fast(spec | {"normalizer": None, "pre_tokenizer": {"type": "Whitespace"}})


def test_packing_odd_input(odd_docs, no_docs, tokenizer):
    got = packing.pack(odd_docs, tokenizer).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r["length"])
    assert by[1] == by[2] == [1] and sum(by[5]) > 2 * 30_000 and None in by
    assert packing.pack(no_docs, tokenizer).count() == 0


# --- sharding


def test_sharding(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = sharding.shard_documents(docs).toPandas()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == len(text) and all(got["size"] == [len(text[d].encode()) + 8 for d in got["doc_id"]]) and all(got["text_crc32"] == [zlib.crc32(text[d].encode()) for d in got["doc_id"]])
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 24 and sizes.max() <= 1.01 * sizes.mean()
    assert got.assign(text=got["doc_id"].map(text)).groupby("text")["shard"].nunique().max() == 1


def test_sharding_splits_a_hot_group(spark):
    docs = spark.createDataFrame([(i, "hot " * 50 if i % 3 else f"cold {i} " * 20) for i in range(3000)], "doc_id long, text string")
    got = sharding.shard_documents(docs, n_shards=6).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() <= 1.02 * sizes.mean() and all(sorted(p["slot"]) == list(range(len(p))) for _, p in got.groupby("shard"))


@pytest.mark.parametrize("doc_id", [None, 5])
def test_sharding_splits_a_hot_group_without_ids(spark, doc_id):
    """Three texts on rows without ids, or with one id: bytes are near equal, and slots have no gap."""
    docs = spark.createDataFrame([(doc_id, f"text {i % 3} " * 50) for i in range(3000)], "doc_id long, text string")
    got = sharding.shard_documents(docs).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 24 and sizes.max() <= 1.15 * sizes.mean() and all(sorted(p["slot"]) == list(range(len(p))) for _, p in got.groupby("shard"))
    again = sharding.shard_documents(docs.repartition(7)).toPandas()
    columns = ["size", "text_crc32", "shard", "slot"]
    assert sorted(map(tuple, got[columns].to_numpy().tolist())) == sorted(map(tuple, again[columns].to_numpy().tolist()))


def test_sharding_odd_input(odd_docs, no_docs):
    got = sharding.shard_documents(odd_docs, n_shards=3).collect()
    assert len(got) == odd_docs.count()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got if r["doc_id"] in (1, 2)} == {1: (8, 0), 2: (8, 0)}
    assert sharding.shard_documents(no_docs).count() == 0
