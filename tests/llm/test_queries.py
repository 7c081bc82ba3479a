"""The registered queries against their SQL, and the columns that are fixed for those without."""

import pytest
from compare import check
from pyspark.sql import functions as F

from presswire.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op2_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op8_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op11_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op10_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert check(QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name])) > 0


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_columns(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert COLUMNS[name].items() <= dict(df.dtypes).items()
    assert df.count() >= spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_licence_query_against_notices(spark, sf_dir):
    """The registered query: families are those whose notices stand in the text, and its counts and spans belong together."""
    from test_licences import NOTICES

    rows = {r["doc_id"]: r for r in QUERIES["op4_license_scan"](spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert set(rows) == set(texts)
    for i, r in rows.items():
        want = sorted({f for k, f in NOTICES.items() if k in texts[i]})
        assert r["families"] == ",".join(want) and r["n_families"] == len(want) and {s["family"] for s in r["spans"]} == set(want)
        assert all(0 <= s["start"] < s["end"] <= len(texts[i]) and 0.5 <= s["p"] <= 1 for s in r["spans"])


def test_fixed_columns_against_sql(spark, sf_dir, duck):
    """What SQL can say of the operators without an oracle: sizes, targets and laws, recomputed by DuckDB."""
    sizes = "select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents"
    targets = f"""with recursive d as ({sizes}), s as (select source, sum(size) as size, row_number() over (order by source nulls last) as i from d group by source),
        w as (select *, [5.0, 2.0, 1.0][1 + (i - 1) % 3] as weight from s), o as (select *, row_number() over (order by 2.0 * size / weight, i) as k, 1.5 * sum(size) over () as total from w),
        c as (select *, total - coalesce(sum(2.0 * size) over (order by k rows between unbounded preceding and 1 preceding), 0) as rest, sum(weight) over (order by k rows between current row and unbounded following) as open from o),
        f as (select *, rest / open * weight > 2.0 * size as over from c), g as (select min(rest / open) filter (not over) as unit from (select * from f where not over order by k limit 1))
        select d.doc_id, d.size, s.size::bigint as source_size, round(case when over then 2.0 * s.size else unit * weight end, 6) as target from d join f s on s.source is not distinct from d.source, g"""
    got = QUERIES["op7_mixing"](spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))
    assert check(got, duck.sql(targets)) > 0
    packed = QUERIES["op8_best_fit_packing"](spark, sf_dir).groupBy("doc_id").agg(F.sum("length").alias("n"), F.min("start").alias("first"), F.max(F.col("start") + F.col("length")).alias("last"), F.count(F.lit(1)).alias("pieces"))
    assert packed.where("n <> last or first <> 0 or pieces <> ceil(n / 2048)").isEmpty()
    shards = QUERIES["op10_sharding"](spark, sf_dir).select("doc_id", "size", "law")
    assert check(shards, duck.sql("select doc_id, octet_length(encode(coalesce(text, '')))::bigint + 8 as size, 'bytes' as law from documents")) > 0
