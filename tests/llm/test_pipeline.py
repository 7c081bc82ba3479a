"""The pipeline, stage by stage, against brute force on a small table."""

import hashlib
from collections import Counter
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_documents import brute_cut, brute_links

from presswire.llm import toxicity
from presswire.llm.common import materialize, shared_dir, table


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    out = [table(spark, sf_dir, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], sf_dir)))
    return out


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_all_but_the_last_keep_the_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(s.schema.simpleString() == stages[0].schema.simpleString() for s in stages[1:5])


def test_toxic_documents_go(spark, sf_dir, stages):
    before, after = by_id(stages[0]), by_id(stages[1])
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(stages[0], toxicity.fit(stages[0], table(spark, sf_dir, "labels"))).collect()}
    assert after == {i: r for i, r in before.items() if scores[i] < 0.3}
    clean = {r["doc_id"] for r in table(spark, sf_dir, "labels").where("toxic = 0").collect()}
    assert len(clean - set(after)) <= 0.03 * len(clean)


def test_one_of_each_group_stays(stages):
    before, after = by_id(stages[1]), by_id(stages[2])
    links = brute_links([(i, r["text"]) for i, r in before.items()])
    assert after == {i: r for i, r in before.items() if links[i][1] == i}


def test_rows_that_share_an_id_are_judged_one_by_one(spark, sf_dir):
    base = [f"w{i}" for i in range(80)]
    copy, near, other, more = " ".join(base), " ".join([*base[:-1], "x"]), " ".join(f"v{i}" for i in range(80)), " ".join(f"u{i}" for i in range(30))
    rows = [(7, copy), (7, copy), (8, near), (8, other), (9, more), (None, copy), (None, None), (10, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each_group(spark, docs, sf_dir).collect())
    assert got == Counter([(7, copy), (8, other), (9, more), (None, copy), (None, None), (10, "")])
    taken = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    assert taken.columns == docs.columns and max(Counter(map(tuple, taken.collect())).values()) <= 4


def test_stages_on_odd_input(spark, sf_dir, odd_docs, no_docs):
    """Nulls, empty and very long texts, repeated rows, clashing and dotted column names; and nothing at all."""
    docs = odd_docs.withColumn("a.b", F.lit(1)).withColumn("_row", F.lit(2)).withColumn("key_a", F.lit(3))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        kept[name] = out.count()
        assert stage(spark, no_docs, sf_dir).count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
    assert kept["toxicity"] in (10, 11) and kept["ngram_jaccard_join"] == 9 and kept["suffix_array_dedup"] == 11 and kept["best_fit_packing"] >= 11


def test_repeats_are_cut(stages):
    before, after = by_id(stages[2]), by_id(stages[3])
    want = brute_cut([(i, r["text"]) for i, r in before.items()])
    assert set(after) == set(before)
    for i, r in after.items():
        assert r["n_chars"] == len(r["text"])
        assert not want[i][1] or len(r["text"].encode()) <= want[i][0] - want[i][1]
        if hashlib.sha256(r["text"].encode()).hexdigest() != want[i][3]:  # a cut inside a character takes its other bytes too
            assert want[i][0] - want[i][1] - len(r["text"].encode()) <= 6 * want[i][2]
        assert want[i][1] or r["text"] == before[i]["text"]


def test_mix_takes_whole_documents(stages):
    before, after = by_id(stages[3]), stages[4].collect()
    assert all(r == before[r["doc_id"]] for r in after)
    assert max(Counter(r["doc_id"] for r in after).values()) <= 2
    words = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(words(stages[4]) / words(stages[3]) - 1.5) < 0.05


def test_packs_every_copy(stages, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    taken = Counter(r["doc_id"] for r in stages[4].collect())
    ids = {i: [*t.encode(r["text"], add_special_tokens=False).ids, 0] for i, r in by_id(stages[4]).items()}
    pieces = stages[5].collect()
    seen, total = Counter(), 0
    for r in pieces:
        seen[r["doc_id"], r["piece"]] += 1
        total += r["length"]
    assert all(n == taken[i] for (i, _), n in seen.items()) and total == sum(len(ids[i]) * n for i, n in taken.items())
    single = [r for r in pieces if taken[r["doc_id"]] == 1]
    by_sequence = Counter()
    for r in pieces:
        by_sequence[r["sequence_id"]] += r["length"]
    assert max(by_sequence.values()) <= 2048
    assert {r["doc_id"] for r in single} == {i for i, n in taken.items() if n == 1}


def test_run_equals_the_stages(spark, sf_dir, stages):
    key = lambda df: Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(stages[5])


def test_run_leaves_one_table(spark, sf_dir):
    folder = Path(shared_dir(spark))
    before = set(folder.iterdir())
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert len(set(folder.iterdir()) - before) == 1
