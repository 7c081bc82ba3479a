"""The corpus operators as registered queries: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswire.llm import balls, chat, jaccard, licences, manifest, mixing, neighbours, packing, pii, sharding, suffixes, topk, toxicity
from presswire.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = topk.to_grid(table(spark, sf_dir, "embeddings"))
    return topk.top_k(grid.where("id % 100 = 0"), grid)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.is_held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.fit(docs)).select("doc_id", F.array_join("families", ",").alias("families"), F.size("families").alias("n_families"), "n_units", "n_unconfirmed", "spans")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema)
    return chat.format_digest(rows.unionByName(extra))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.col("copies.shard").alias("shards"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_documents(table(spark, sf_dir, "documents"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balls.cluster(balls.to_grid(table(spark, sf_dir, "embeddings"))).drop("compared")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def _assigned(vectors: str, centroids: str) -> str:
    """SQL: the vectors (r, vec_id, g) with their nearest centroid of (c, m) and its squared distance."""
    return f"""(select r, any_value(vec_id) as vec_id, any_value(g) as g, arg_min(c, d * 1000 + c)::integer as c, min(d) as d
          from (select r, vec_id, g, c, list_sum(list_transform(list_zip(g, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from {vectors} cross join {centroids}) x group by r)"""


def _moved(assigned: str, centroids: str) -> str:
    """SQL: the centroids after the assignment; floor of a quotient by way of the remainder."""
    return f"""(select k.c, case when count(a.i) = 0 then any_value(k.m) else list((s - ((s % n) + n) % n) // n order by i) end as m from {centroids} k left join
          (select c, i, sum(x)::bigint as s, count(*)::bigint as n from (select c, unnest(g) as x, unnest(range(len(g))) as i from {assigned}) y group by c, i) a on a.c = k.c group by k.c)"""


_ENCODED = lambda x: f"coalesce(octet_length(encode(({x})::varchar)) || ':' || ({x})::varchar, '-')"
_LEAF = lambda text: "sha256(" + " || ".join(map(_ENCODED, ["doc_id", "source", "lang", "n_chars", text])) + ")"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32 bit by bit: a register and the bytes of the decimal doc_id, eight steps for each.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
            lambda r, b: list_reduce(list_concat([xor(r, b)], [1, 1, 1, 1, 1, 1, 1, 1]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": op1_exact_topk,
    "op2_toxicity": op2_toxicity,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_mixing": op7_mixing,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_sharding": op10_sharding,
    "op11_pii": op11_pii,
    "op12_ball_kmeans": op12_ball_kmeans,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {
    "op1_exact_topk": """
        with v as (
          select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as g from embeddings
          where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
          select q.r as q, q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.g, c.g), lambda z: z[1] * z[2]))::bigint as score
          from v q join v c on q.vec_id % 100 = 0 and q.r <> c.r
        ), r as (select *, row_number() over (partition by q order by score desc, vec_id) as rank from s)
        select query_id, rank::integer as rank, vec_id, score from r where rank <= 10""",
    "op3_embedding_near_dedup": """
        with recursive v as (
          select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
          where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), u as (select vec_id, label, e from v where list_dot_product(e, e) > 0),
        l as (
          select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id
          where list_cosine_similarity(a.e, b.e) >= 0.98
        ), r as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from r join l on r.b = l.a)
        select vec_id, (select count(*) from l where a = vec_id) as n_links, (select min(b) from r where a = vec_id) as component_id,
          vec_id = (select min(b) from r where a = vec_id) as kept
        from embeddings""",
    "op5_suffix_array_dedup": """
        with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
        b as (select doc_id, 200 * i as base, substring(h, 400 * i + 1, 498) as h from (select doc_id, h, unnest(range(0, length(h) // 400 + 1)) as i from d) x),
        w as (select doc_id, base + q as p, substring(h, 2 * q + 1, 100) as x from (select *, unnest(range(0, least(200, greatest(length(h) // 2 - 49, 0)))) as q from b) y),
        m as (select x, min(doc_id) as least from w group by x),
        s as (select doc_id, p, m.least from w join m on w.x = m.x),
        c as (select doc_id, p, p > lag(p) over (partition by doc_id order by p) + 50 as gap from s where least < doc_id),
        g as (select doc_id, p, sum(case when gap then 1 else 0 end) over (partition by doc_id order by p) as run from c),
        r as (select doc_id, run, min(p) as lo, max(p) + 50 as hi from g group by 1, 2),
        k as (select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as since from r),
        t as (select d.doc_id, any_value(h) as h, count(lo) as n_spans, coalesce(sum(hi - lo), 0)::bigint as n_removed,
          coalesce(string_agg(substring(h, 2 * since + 1, 2 * (lo - since)), '' order by lo), '') as head, coalesce(max(hi), 0) as last
          from d left join k on d.doc_id = k.doc_id group by d.doc_id)
        select doc_id, length(h) // 2 as n_bytes, n_removed, n_spans, sha256(unhex(head || substring(h, 2 * last + 1))) as kept_sha256 from t""",
    "op9_ngram_jaccard": """
        with recursive w as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\s\\xA0]+'), lambda x: x <> '') as ws from documents where doc_id is not null),
        s as (select doc_id, case when len(ws) >= 5 then list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')))
          when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as g from w),
        e as (select doc_id, unnest(g) as x, len(g) as n from s),
        p as (select a.doc_id as a, b.doc_id as b, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
        l as (select * from p where c >= 0.8 * (na + nb - c) - 1e-9),
        r as (select doc_id as a, doc_id as b from s union select r.a, l.b from r join l on r.b = l.a)
        select doc_id, least(doc_id, coalesce((select min(b) from l where a = doc_id and c = na and c = nb), doc_id)) as class_id,
          (select min(b) from r where a = doc_id) as component_id, (select count(*) from l where a = doc_id) as n_links, len(g)::bigint as n_shingles,
          doc_id = (select min(b) from r where a = doc_id) as kept
        from s""",
    "op6_chat_formatting": """
        with rows as (
          select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
          union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), coded as (
          select *, replace(replace(replace(replace(replace(replace(text, '\\', '\\b'), '<|', '\\c'), '<s>', '\\s'), '</s>', '\\e'), '[INST]', '\\i'), '[/INST]', '\\j') as code,
            length('<|turn|>' || role || chr(10) || '<|end|>' || chr(10)) as frame
          from rows
        )
        select conv_id, count(*) as n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
          coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
          sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
          sum(frame + length(code))::bigint as formatted_chars
        from coded group by conv_id""",
    "op12_ball_kmeans": f"""
        with v as (
          select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as g from embeddings
          where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), c0 as (select row_number() over (order by sha256('1:' || vec_id) nulls last, g) - 1 as c, g as m from v qualify c < 16),
        a0 as {_assigned("v", "c0")}, c1 as {_moved("a0", "c0")}, a1 as {_assigned("v", "c1")}, c2 as {_moved("a1", "c1")}, a2 as {_assigned("v", "c2")}, c3 as {_moved("a2", "c2")}, a3 as {_assigned("v", "c3")}
        select vec_id, a3.c as cluster, d as distance, sum(d) over (partition by a3.c)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
        from a3 join c3 on a3.c = c3.c""",
    "op13_merkle_manifest": f"""
        with recursive e as (
          select doc_id, lang, {_LEAF("text")} as leaf, case when {_CRC} % 3 = 0 then {_LEAF(_LOWERED)} end as tampered from documents
        ), l as (
          select *, row_number() over (order by lang nulls first, doc_id nulls first, leaf) as row, dense_rank() over (order by lang nulls first) - 1 as g,
            row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from e
        ), t as (
          select 0 as k, g, i, n, leaf as d from l
          union all select k + 1, g, i // 8, (n + 7) // 8, sha256(string_agg(d, '' order by i)) from t where n > 1 group by k, g, i // 8, n
        ), s as (select g as i, d from t where n = 1),
        u as (
          select 0 as k, i, (select count(*) from s) as n, d from s
          union all select k + 1, i // 8, (n + 7) // 8, sha256(string_agg(d, '' order by i)) from u where n > 1 group by k, i // 8, n
        ), p as (
          select 0 as up, k, g, i, coalesce(string_agg(d, '' order by i) over (partition by k, g, i // 8 order by i rows between unbounded preceding and 1 preceding), '') as a,
            coalesce(string_agg(d, '' order by i) over (partition by k, g, i // 8 order by i rows between 1 following and unbounded following), '') as b from t where n > 1
          union all
          select 1, k, 0, i, coalesce(string_agg(d, '' order by i) over (partition by k, i // 8 order by i rows between unbounded preceding and 1 preceding), ''),
            coalesce(string_agg(d, '' order by i) over (partition by k, i // 8 order by i rows between 1 following and unbounded following), '') from u where n > 1
        ), way as (
          select l.row, up, p.k, a, b, row_number() over (partition by l.row order by up, p.k) as step from l join p on (up = 0 and p.g = l.g and p.i = l.i // power(8, p.k)::bigint) or (up = 1 and p.i = l.g // power(8, p.k)::bigint)
        ), f as (
          select row, 1 as step, coalesce(tampered, leaf) as d from l
          union all select f.row, f.step + 1, sha256(w.a || f.d || w.b) from f join way w on w.row = f.row and w.step = f.step
        ), last as (select row, arg_max(d, step) as folded from f group by row), proof as (select row, string_agg(a || b, '' order by step) as x from way group by row),
        r as (select d from u where n = 1)
        select doc_id, leaf, s.d as subroot, r.d as root, sha256(coalesce(x, '')) as proof_sha256, folded as folded_root, folded = r.d as verified
        from l join s on s.i = l.g join last on last.row = l.row left join proof on proof.row = l.row, r""",
}
