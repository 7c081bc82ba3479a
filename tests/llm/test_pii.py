"""Personal data: fixed forms against plain regular expressions, and discovery against a brute-force form of the same graph."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from presswire.llm import pii
from presswire.llm.queries import QUERIES

FORMS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    """The fixed forms as the definition reads."""
    out = []
    for k, (_, pattern) in enumerate(FORMS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = [True, max(map(int, re.findall("[0-9]+", m[0])), default=0) <= 255, 13 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15][k]
            if good:
                out.append((k, *m.span()))
    return out


def shown(spans):
    return ",".join(f"{FORMS[k][0]}:{a}:{b}" for k, a, b in sorted(spans))


def test_fixed_forms_on_random_texts():
    rng = random.Random(5)
    pieces = ["a@b.c", "@", ".", "-", "+", "1", "22", "255", "256", " ", "(", ")", "4111 1111 1111 1111", "4111111111111111", "+1 (212) 555-0100", "x_y%z", "b.c", "10.0.0.1", "\n", "é", "%", "00", "  "]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25)))
        assert sorted(pii.base_spans(text)) == sorted(plain(text)), text


def test_long_texts_take_one_pass():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1." * 1_000_000, "1 " * 1_000_000 + "x", "@" * 500_000, "a@" * 500_000, "+1(" * 300_000, "1 1-" * 300_000, "a@b." * 300_000, "(at)" * 200_000):
        pii.occurrences(text)


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("jane (at) example (dot) org", 0), ("jane [at] example.org", 0), ("root@localhost", 0), ("10[.]20[.]30[.]40", 1), ("2001:db8:0:1:2:3:4:5", 1), ("4111-1111.1111-1112", 2), ("(212) 555-0100", 3), ("212.555.0100", 3),
    ],
)
def test_loose_forms(text, kind):
    for around in ("write to %s now", "%s", "x: %s."):
        whole = around % text
        start = whole.index(text)
        assert (kind, start, start + len(text)) in pii.loose_spans(whole, pii.base_spans(whole)), whole


def test_loose_forms_leave_prose_alone():
    for text in ("version 3.0 of 2024", "about 12 o'clock at 10:30:15", "pages 10-12 (see [4])", "f(x) at (0.5, 0.25)", "2a01 x5 item#4"):
        assert not pii.loose_spans(text, [])


#: Identifiers in fixed form follow three phrases, others of them too; one phrase is learned from what the first ones found.
def planted():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    number = lambda: f"{rng.randrange(200, 999)} {rng.randrange(200, 999)} {rng.randrange(1000, 9999)}"
    texts, hidden = [], []
    for i in range(12):
        texts.append(f"{prose(20)} hotline number: +1 {number()} {prose(10)}")
        texts.append(f"{prose(9)} mail us at user{i}@host{i}.example.com {prose(7)}")
    for i in range(5):
        own = f"({rng.randrange(200, 999)}) 555-{1000 + i}"
        texts.append(f"{prose(5)} hotline number: {own}, {prose(12)}")
        texts.append(f"{prose(5)} ring the desk on {own} {prose(4)}")
        hidden += [("phone", own)] * 2
    late = "(646) 555-7777"
    texts.append(f"{prose(3)} ring the desk on {late} {prose(3)}")
    address = "jane (at) host (dot) example"
    texts.append(f"{prose(3)} mail us at {address} {prose(3)}")
    texts.append(f"order {rng.randrange(10**15, 10**16)} of {prose(30)}, no. {number()}")
    texts += [texts[0]] * 3 + ["", None, prose(40)]
    return [(i, t) for i, t in enumerate(texts)], [*hidden, ("phone", late), ("email", address)]


def brute(rows, rounds=4):
    """discovered(), on sets in memory."""
    occ = [(i, o) for i, t in rows for o in pii.occurrences(t or "")]
    tokens = [[w.lower() for w in pii.TOKEN.findall(t or "")] for _, t in rows]
    total = defaultdict(int)
    for ws in tokens:
        for n in (2, 3):
            for j in range(len(ws) - n + 1):
                total[" ".join(ws[j : j + n])] += 1
    edges = defaultdict(int)
    for _, (k, _, _, _, v, cs) in occ:
        for c in cs:
            edges[(k, c), v] += 1
    seeds = {(k, v) for _, (k, base, _, _, v, _) in occ if base}
    score = {(o[0], o[4]): float((o[0], o[4]) in seeds) for _, o in occ}
    for _ in range(rounds):
        sure = {}
        for p in {p for p, _ in edges}:
            own = {v: n for (q, v), n in edges.items() if q == p}
            conf = sum(n * score[p[0], v] for v, n in own.items()) / (total[p[1].strip()] + 1)
            if conf >= 0.5 and sum(score[p[0], v] >= 0.5 for v in own) >= 3:
                sure[p] = conf
        score = {(k, v): 1.0 if (k, v) in seeds else 1 - math.prod(1 - min(c, 1 - 1e-9) for p, c in sure.items() if p[0] == k and (p, v) in edges) for k, v in score}
    spans = defaultdict(list)
    best = {}
    for i, (k, base, a, b, v, _) in occ:
        if base:
            spans[i].append((k, a, b))
        elif score[k, v] >= 0.5 and (best.get((i, a)) is None or (-score[k, v], k) < best[i, a][0]):
            best[i, a] = ((-score[k, v], k), (k, a, b))
    for (i, _), (_, s) in best.items():
        spans[i].append(s)
    return spans


def test_discovery_equals_brute_force(spark):
    rows, hidden = planted()
    got = {r["doc_id"]: r for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    for i, text in rows:
        base = plain(text or "")
        assert got[i]["spans"] == shown(want[i])
        assert got[i]["base_sha256"] == hashlib.sha256(shown(base).encode()).hexdigest()
        assert [got[i][f"n_{name}"] for name, _ in FORMS] == [sum(k == j for k, _, _ in base) for j in range(4)]
    texts = dict(rows)
    found = {(part.split(":")[0], texts[i][int(part.split(":")[1]) : int(part.split(":")[2])]) for i, r in got.items() for part in r["spans"].split(",") if part}
    assert set(hidden) <= found
    assert not any(texts[i].startswith("order") and r["spans"] for i, r in got.items() if texts[i])


def test_registered_query_against_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op11_pii"](spark, sf_dir).collect()}
    want = brute(rows)
    assert len(got) == len(rows) and sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in got.values()) > 0
    for i, text in rows:
        assert got[i]["spans"] == shown(want[i])
        assert got[i]["base_sha256"] == hashlib.sha256(shown(plain(text or "")).encode()).hexdigest()


def test_totals_in_blocks(spark):
    docs = spark.createDataFrame([("a b c a b",), ("A b  c",), (None,)], "text string")
    asked = spark.createDataFrame([("a b",), ("b c",), ("a b c",), ("x y",)], "words string")
    for block in (1, 2, 100):
        assert {r["words"]: r["total"] for r in pii.totals(docs, asked, block).collect()} == {"a b": 3, "b c": 2, "a b c": 2}


def test_odd_rows(odd_docs, no_docs):
    assert pii.scan(no_docs).isEmpty()
    rows = pii.scan(odd_docs)
    assert rows.count() == odd_docs.count()
    assert rows.where(F.col("doc_id").isNull()).count() == 1
    assert rows.where("spans <> '' or n_email + n_ip + n_card + n_phone > 0").isEmpty()
