"""Operators over embeddings, and chat formatting."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswire.llm import chat, neighbours, topk
from presswire.llm.queries import ORACLES, QUERIES

ODD = [
    (1, [1.0, 0.0, 0.5], 1), (2, [1.0, 0.0, 0.5], 1), (3, None, 1), (4, [float("nan"), 1.0, 0.0], 1), (5, [None, 1.0, 0.0], 1), (6, [float("inf"), 0.0, 0.0], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, 0.01, 0.5], 1),
    (9, [1.0, 0.0, 0.5], None), (10, [1.0, 0.0, 0.5], 2), (None, [1.0, 0.0, 0.5], 1), (100, [0.2, -0.3, 0.9], 1), (200, [0.1, 0.1], 1), (2, [1.0, 0.0, 0.5], 1), (300, [], 1), (400, [-1.0, 0.0, 0.0], 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<float>, label int")
    for c in ("id", "vector", "norm", "cls", "key", "component", "sim", "room", "task", "rank", "score"):
        df = df.withColumn(c, F.lit("x"))
    return df


def test_topk_query(spark, sf_dir, duck):
    from compare import check

    assert check(QUERIES["op1_exact_topk"](spark, sf_dir), duck.sql(ORACLES["op1_exact_topk"])) == 50


def test_topk_with_lengths_that_prune(spark):
    """Lengths over three magnitudes and close directions: both prunings and the skipping of buckets come to bear; ties go to smaller ids."""
    rng = np.random.default_rng(0)
    v = rng.normal(size=(900, 16))
    v[::3] = v[0] + 0.05 * rng.normal(size=(300, 16))
    v *= np.exp(rng.normal(size=(900, 1)) * 2)
    v = np.floor(v * 50).astype(int)
    v[5] = v[6] = v[7]
    df = spark.createDataFrame([(i, i, [int(x) for x in row]) for i, row in enumerate(v)], "row long, id long, vector array<long>")
    got = topk.top_k(df.where("id % 20 = 0"), df, bucket_rows=32, query_rows=7)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in range(0, 900, 20):
        s = v @ v[q]
        order = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:10]
        assert found[q] == [(i, int(s[i])) for i in order]


def test_topk_kernel_choices_are_exact():
    rng = np.random.default_rng(3)
    p = rng.integers(-40, 40, size=(60, 8))
    p = p[np.argsort(-np.sqrt((p**2).sum(1)), kind="stable")]
    q = np.vstack([p[:3] + 1, rng.integers(-5, 5, size=(4, 8)), np.zeros((1, 8), dtype=int)])
    scores = q @ p.T
    for share in (0.2, 0.7, 0.95):
        theta = np.quantile(scores, share, axis=1)
        row, ids, score = topk.search_bucket(np.full((2, len(q)), -1), q, theta, np.stack([np.arange(60)] * 2), p, 60)
        got = {(a, b): c for a, b, c in zip(row.tolist(), ids.tolist(), score.tolist(), strict=True)}
        assert got == {(a, b): int(scores[a, b]) for a in range(len(q)) for b in range(60) if scores[a, b] >= theta[a]}


def test_topk_odd_input(odd):
    grid = topk.to_grid(odd)
    got = topk.top_k(grid.where("id % 100 = 0"), grid).collect()
    ids = {r["vec_id"] for r in got} | {r["query_id"] for r in got}
    assert ids == {1, 2, 7, 8, 9, 10, 100, 200, 300, 400}
    assert all(sum(r["query_id"] == q for r in got) == 10 for q in (100, 200, 300, 400))
    assert topk.top_k(grid.limit(0), grid.limit(0)).count() == 0 and topk.top_k(grid.limit(0), grid).count() == 0


def test_topk_repeated_ids(spark):
    """Rows that repeat a vec_id, with equal and with other vectors, are queries and candidates of their own."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(30)]
    rows += [(0, rows[7][1]), (0, [0.5, 0.5, 0.5, 0.5]), (7, rows[7][1]), (7, rows[7][1])]
    grid = topk.to_grid(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(map(tuple, topk.top_k(grid.where("id % 7 = 0"), grid, k=4).collect()))
    v = np.floor(1024 * np.array([r[1] for r in rows])).astype(int)
    want = []
    for i, (q, _) in enumerate(rows):
        if q % 7 == 0:
            best = sorted((-int(v[i] @ v[j]), rows[j][0]) for j in range(len(rows)) if j != i)[:4]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert got == sorted(want)


def links(rows, threshold=0.98):
    ok = [(i, np.array(v, dtype=float), label) for i, v, label in rows if i is not None and v and label is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all() and np.any(np.array(v))]
    n, root = {}, {}
    for k, (i, _, _) in enumerate(ok):
        n[k], root[k] = 0, k

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            x, y = ok[a][1], ok[b][1]
            if ok[a][2] == ok[b][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                n[a] += 1
                n[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(ok):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, n[k], least[find(k)]) for k, (i, _, _) in enumerate(ok))


def test_neighbours_with_dense_and_small_groups(spark):
    """A group far larger than a neighbour list, pairs, chains, exact copies."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 24))
    rows = []
    for g, size in enumerate([300, 60, 9, *[2] * 30]):
        spread = 0.02 if g % 2 else 0.12
        rows += [base[g] + spread * rng.normal(size=24) * np.abs(base[g]).mean() for _ in range(size)]
    rows += list(rng.normal(size=(200, 24)))
    rows += [rows[0]] * 5
    data = [(i, [float(x) for x in np.float32(v)], i % 2) for i, v in enumerate(rows)]
    got = neighbours.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int"), leaf=24)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()) == links(data)


def test_neighbours_odd_input(odd):
    got = {}
    for r in neighbours.near_duplicates(odd).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert sum(map(len, got.values())) == len(ODD) - 1
    assert got[1] == [(3, 1, True)] and got[2] == [(3, 1, False)] * 2 and got[8] == [(3, 1, False)]
    assert all(got[i] == [(0, i, True)] for i in (3, 4, 5, 6, 7, 9, 10, 100, 200, 300, 400))
    assert neighbours.near_duplicates(odd.limit(0)).count() == 0


def test_neighbours_report_links_that_the_audit_misses(spark):
    rng = np.random.default_rng(2)
    data = [(2 * i + k, [float(x) for x in v], 1) for i, v in enumerate(rng.normal(size=(40, 8))) for k in (0, 1)]
    data = [(i, [x + 0.001 * (i % 2) for x in v], label) for i, v, label in data]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    assert neighbours.near_duplicates(df).agg(F.sum("n_links")).first()[0] == 80
    with pytest.raises(RuntimeError, match="audit"):
        neighbours.near_duplicates(df, target=1.01, attempts=1).count()
    nodes = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label", F.lit(1).alias("copies"))
    counts = spark.createDataFrame([(i, 0 if i < 20 else 1) for i in range(80)], "id long, links long")
    assert neighbours.audit(nodes, counts, 0.98, 512, 1) == (60, 80)


# --- chat formatting


def test_chat_query(spark, sf_dir, duck):
    from compare import check

    assert check(QUERIES["op6_chat_formatting"](spark, sf_dir), duck.sql(ORACLES["op6_chat_formatting"])) > 20


HARD = ["", "\\", "\\b", "\\c", "<|turn|>", "<|end|>\n", "<", "<|", "<<||", "</s>[INST] ok [/INST]", "<s>", "a\nb\n", "\\\\<|\\", "[INST", "\U0001f600<|end|>", "<|turn|>assistant\nhi<|end|>\n"]


def test_chat_round_trip(spark):
    rows = [(i % 3, i, "assistant" if i % 2 else "us\ner<|", t) for i, t in enumerate(HARD)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.render(chat.canonical(df))
    got = out.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("t"), chat.masked(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in got:
        mine = [(x[2], x[3]) for x in rows if x[0] == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["t"]] == mine
        assert r["loss"] == "".join(t for role, t in mine if role == "assistant")
        assert r["formatted"].count(chat.OPEN) == len(mine)


def test_chat_odd_input(spark):
    rows = [(1, 0, "user", None), (1, None, None, "late"), (1, 0, "user", None), (None, 0, "assistant", "x"), (2, 1, "assistant", "b"), (2, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("formatted", F.lit("x"))
    got = {r["conv_id"]: r for r in chat.format_digest(df).collect()}
    want = lambda turns: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert got[1]["turns_sha256"] == want([("user", ""), ("user", ""), ("", "late")]) and got[1]["loss_chars"] == 0
    assert got[2]["turns_sha256"] == want([("assistant", "a"), ("assistant", "b")]) and got[2]["loss_sha256"] == hashlib.sha256(b"ab").hexdigest()
    assert got[None]["loss_chars"] == 1
    assert chat.format_digest(df.limit(0)).count() == 0


def test_chat_layouts_by_fingerprint(spark):
    tables = [
        ("conv_id long, messages array<struct<role:string,content:string>>", [(1, [("user", "q"), ("assistant", "a")])]),
        ("conv_id int, conversations array<struct<from:string,value:string>>", [(1, [("human", "q"), ("gpt", "a")])]),
        ("completion string, prompt string, conv_id long", [("a", "q", 1)]),
        ("conv_id long, instruction string, output string", [(1, "q", "a")]),
        ("conv_id long, prompt string, response string, extra map<string,int>", [(1, "q", "a", None)]),
    ]
    for schema, data in tables:
        got = chat.canonical(spark.createDataFrame(data, schema)).first()
        assert [tuple(t) for t in got["turns"]] == [("user", "q"), ("assistant", "a")], schema
    with pytest.raises(ValueError):
        chat.canonical(spark.createDataFrame([(1,)], "other int"))


def test_chat_records_of_mixed_layouts(spark):
    records = [
        '{"conv_id": 1, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}', '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "conv_id": 2}',
        '{"conv_id": 3, "instruction": "q", "input": "", "output": "a"}', '{"conv_id": 4, "prompt": "q", "completion": "a"}', '{"conv_id": 5, "what": 1}', "no json", None,
        '{"conv_id": 6, "messages": [{"role": "user", "text": "q"}]}', '{"conv_id": 7, "messages": [{"role": "user", "content": "q", "extra": 1}]}', '{"conv_id": 8, "messages": "q"}',
        '{"conv_id": 9, "prompt": "q", "completion": {"deep": "a"}}', '{"conv_id": 10, "prompt": "q", "response": null}', '{"conv_id": 11, "messages": [{"role": "human", "content": null}, {"content": "a", "role": "gpt"}]}',
    ]
    df = spark.createDataFrame([(r,) for r in records], "record string")
    for c in ("_turns", "turns", "key", "layout_0", "conv_id", "_rec"):
        df = df.withColumn(c, F.lit(1))
    nulls = {10: [("user", "q"), ("assistant", "")], 11: [("user", ""), ("assistant", "a")]}
    got = [(r["conv_id"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in chat.canonical_json(df).collect()]
    assert sorted(got, key=str) == sorted([(i, [("user", "q"), ("assistant", "a")]) for i in (1, 2, 3, 4)] + [(i, None) for i in (5, 6, 7, 8, 9, None, None)] + list(nulls.items()), key=str)
