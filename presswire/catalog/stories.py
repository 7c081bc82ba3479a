"""Queries over outlets and stories of the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswire import dims
from presswire.functions import rating, text
from presswire.operators import ordered

STORIES = 47  # coprime to the number of outlets, so that stories mix them
TOPICS = ["tion", "ther", "than", "thre", "with"]


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: story_id, pos (arrival), outlet, text, with the outlet's bias (null if not rated)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.pmod("doc_id", F.lit(STORIES)).alias("story_id"), F.col("doc_id").alias("pos"), F.col("source").alias("outlet"), "text")
    return rows.join(F.broadcast(dims.outlet_bias(spark)), "outlet", "left")


ARTICLES = f"""(select d.doc_id % {STORIES} as story_id, d.doc_id as pos, d.source as outlet, d.text, b.bias, b.category
  from documents d left join {dims.OUTLET_SQL} b on d.source = b.outlet)"""


def bias_spread_by_story(spark, sf_dir):
    left, right = F.count_if(F.col("bias") <= -2), F.count_if(F.col("bias") >= 2)
    out = articles(spark, sf_dir).groupBy("story_id").agg(F.count(F.lit(1)).alias("n_sources"), left.alias("left_count"), right.alias("right_count"))
    return out.withColumn("bias_spread_met", (F.col("left_count") > 0) & (F.col("right_count") > 0))


def bias_distribution(spark, sf_dir):
    """Unrated outlets have bias 0 and so count as center. The report covers a story's first 20."""
    rows = ordered.cap(articles(spark, sf_dir), ["story_id"], ["pos"], 20).withColumn("b", F.coalesce("bias", F.lit(0)))
    return rows.groupBy("story_id").agg(
        F.count_if(F.col("b") < 0).alias("left_n"), F.count_if(F.col("b") == 0).alias("center_n"), F.count_if(F.col("b") > 0).alias("right_n"), F.count_if(F.col("bias").isNotNull()).alias("known_n")
    )


def bias_label_lookup(spark, sf_dir):
    rows = articles(spark, sf_dir).select("pos", "outlet", "bias", "category")
    b = F.coalesce("bias", F.lit(0))
    return rows.select(
        "pos", "outlet", b.alias("bias"), F.when(F.col("bias").isNull(), "Unknown").otherwise(rating.label(F.col("bias"))).alias("bias_label"),
        F.when(F.col("bias").isNull(), "unknown").otherwise("dataset").alias("method"), F.coalesce(rating.interpretation(b, F.col("category")), F.lit("")).alias("interpretation"),
    )


LABEL_CASE = "case bias " + " ".join(f"when {k} then '{v}'" for k, v in dims.BIAS_LABELS.items()) + " end"


def bias_comparison_sorted(spark, sf_dir):
    """A story's first 20 articles by bias, ties in arrival order."""
    rows = ordered.cap(articles(spark, sf_dir), ["story_id"], ["pos"], 20).withColumn("bias", F.coalesce("bias", F.lit(0)))
    return rows.select("story_id", "pos", "bias", F.row_number().over(Window.partitionBy("story_id").orderBy("bias", "pos")).alias("rank"))


def sampler_input(spark, sf_dir):
    return articles(spark, sf_dir).select("story_id", "pos", F.lower("outlet").alias("domain"), "bias", F.length("text").alias("text_length"))


def balanced_sampler(spark, sf_dir):
    return ordered.balanced_sample(sampler_input(spark, sf_dir)).select("story_id", "pos", "domain", F.coalesce("bias", F.lit(99)).alias("bias"), "kept_before")


SAMPLER = f"""
  with c as (
    select story_id, pos, lower(outlet) as domain, bias, row_number() over (partition by story_id, lower(outlet) order by pos) as rn from {ARTICLES} a where length(text) >= 200
  ), k as (
    select *, count(*) over w as kept_before, coalesce(max(case when bias <= -2 then 1 else 0 end) over w, 0) as l, coalesce(max(case when bias >= 2 then 1 else 0 end) over w, 0) as r
    from c where rn = 1 window w as (partition by story_id order by pos rows between unbounded preceding and 1 preceding)
  ), s as (select * from k where kept_before < 5 and not (l = 1 and r = 1 and kept_before >= 2))"""


def sources_by_story(spark, sf_dir):
    """Kept sources a story, and the error of stories with fewer than two."""
    kept = ordered.balanced_sample(sampler_input(spark, sf_dir)).groupBy("story_id").agg(F.count(F.lit(1)).alias("n_sources"))
    return kept.withColumn("error", F.when(F.col("n_sources") < 2, "too few sources").otherwise(""))


def story_status(spark, sf_dir):
    """Lifecycle: stories that kept two sources are analyzed, the others failed; their title is the first text's first 100 characters."""
    rows = articles(spark, sf_dir)
    first = ordered.keep_first(rows, ["story_id"], ["pos"]).select("story_id", F.substring("text", 1, 100).alias("title"))
    kept = sources_by_story(spark, sf_dir).select("story_id", "n_sources")
    out = first.join(kept, "story_id", "left")
    return out.select("story_id", "title", F.when(F.coalesce("n_sources", F.lit(0)) >= 2, "analyzed").otherwise("failed").alias("status"))


def second_article_same_domain(spark, sf_dir):
    """For each unrated article the next one of its outlet within the story."""
    rows = articles(spark, sf_dir).select("story_id", "pos", "outlet", "bias")
    own = Window.partitionBy("story_id", "outlet").orderBy("pos")
    return rows.withColumn("second_pos", F.coalesce(F.lead("pos").over(own), F.lit(-1))).where("bias is null").select("story_id", "pos", "second_pos")


def bias_resolution_chain(spark, sf_dir):
    """Dataset, then a site rating (documents whose id divides by 5), then a model's answer (by 7), then the lexicon."""
    from presswire.operators.joins import resolve_bias

    rows = articles(spark, sf_dir).select("pos", "bias", "text")
    rows = rows.withColumns(
        {
            "site": F.when(F.col("pos") % 5 == 0, (F.col("pos") % 3 - 1).cast("int") * 2),
            "reply": F.when(F.col("pos") % 7 == 0, F.concat(F.lit('noise {"bias": '), (F.col("pos") % 11 - 5).cast("string"), F.lit(', "confidence": 1.5} end'))),
        }
    )
    rows = rows.withColumn("model", rating.model_answer(F.col("reply"))).withColumnRenamed("bias", "known")
    return resolve_bias(rows, "known", "site", "model", text.score_two_sided(F.col("text"))).select("pos", "method", "bias", "confidence")


def facts(spark, sf_dir):
    """Sides on which each five-letter word of a story's rated articles stands, as claims do."""
    rows = articles(spark, sf_dir).where(F.abs("bias") >= 2)
    words = rows.select("story_id", (F.col("bias") < 0).alias("is_left"), F.explode(F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) == 5))).alias("fact"))
    return words.groupBy("story_id", "fact").agg(F.max("is_left").alias("l"), F.max(~F.col("is_left")).alias("r"))


def _facts(condition: str):
    return lambda spark, sf_dir: facts(spark, sf_dir).where(condition).select("story_id", "fact")


FACTS = f"""select story_id, fact from (
  select story_id, fact, max(case when bias < 0 then 1 else 0 end) as l, max(case when bias > 0 then 1 else 0 end) as r
  from (select story_id, bias, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) = 5)) as fact from {ARTICLES} a where abs(bias) >= 2) w group by story_id, fact) f where """


def topic_match_score(spark, sf_dir):
    low = F.lower("text")
    counts = [text.count_of(low, F.lit(t)) for t in TOPICS]
    found, total = sum((c > 0).cast("int") for c in counts), sum(counts)
    out = articles(spark, sf_dir).select("pos", found.alias("found"), total.cast("long").alias("total"))
    return out.withColumn("relevance", F.round(F.least(F.lit(1.0), F.col("found") / len(TOPICS) + F.col("total") / 100), 6))


_COUNT = lambda t: f"((length(lower(text)) - length(replace(lower(text), '{t}', ''))) // {len(t)})"


def word_frequency_top5(spark, sf_dir):
    """The five most frequent of an article's first 500 long words, ties by first place."""
    words = articles(spark, sf_dir).select("pos", text.long_words(F.col("text")).alias("words"))
    # Dealt by article while its words are one row, so that neither the counts nor the ranks shuffle a row for each word.
    rows = words.repartition("pos").select("pos", F.posexplode("words").alias("at", "word"))
    counts = rows.groupBy("pos", "word").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    rank = F.row_number().over(Window.partitionBy("pos").orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", rank).where("rank <= 5").select("pos", "rank", "word", "n")


def lexicon_heuristic(spark, sf_dir):
    rows = articles(spark, sf_dir)
    return rows.select("pos", text.present(F.col("text"), text.LEFT_WORDS).alias("left_n"), text.present(F.col("text"), text.RIGHT_WORDS).alias("right_n"), text.score_two_sided(F.col("text")).alias("bias"))


def _present(words):
    return " + ".join(f"(case when contains(lower(text), '{w}') then 1 else 0 end)" for w in words)


def tokenize_set(spark, sf_dir):
    t = text.tokens(F.col("text"))
    return articles(spark, sf_dir).select("pos", F.size(t).alias("n_tokens"), F.md5(F.array_join(F.array_sort(t), " ")).alias("tokens_md5"))


def bias_rollup(spark, sf_dir):
    rows = articles(spark, sf_dir).select(F.coalesce(F.col("bias").cast("string"), F.lit("unknown")).alias("bias"), F.coalesce("category", F.lit("none")).alias("category"), F.length("text").alias("n"))
    return rows.rollup("bias", "category").agg(F.count(F.lit(1)).alias("n_articles"), F.sum("n").alias("chars")).select(F.coalesce("bias", F.lit("all")).alias("bias"), F.coalesce("category", F.lit("all")).alias("category"), "n_articles", "chars")


def bias_cube(spark, sf_dir):
    rows = articles(spark, sf_dir).select(F.coalesce(F.col("bias").cast("string"), F.lit("unknown")).alias("bias"), F.coalesce("category", F.lit("none")).alias("category"))
    return rows.cube("bias", "category").agg(F.count(F.lit(1)).alias("n_articles")).select(F.coalesce("bias", F.lit("all")).alias("bias"), F.coalesce("category", F.lit("all")).alias("category"), "n_articles")


_GROUPED = "select coalesce(bias, 'all') as bias, coalesce(category, 'all') as category, {what} from (select coalesce(bias::varchar, 'unknown') as bias, coalesce(category, 'none') as category, length(text) as n from " + ARTICLES + " a) x group by {how}(bias, category)"


def rhetoric_markers(spark, sf_dir):
    """Sentences by marker family; the marker words are the rubric's, and tokens that occur in the tables."""
    families = text.RHETORIC | {"frequent": ["the", "with", "that"]}
    rows = articles(spark, sf_dir).select("pos", F.explode(F.split(F.lower("text"), r"[.!?\n]+")).alias("s")).where("s <> ''")
    out = rows.groupBy("pos").agg(F.count(F.lit(1)).alias("n_sentences"), *[F.count_if(F.col("s").rlike(rf"\b({'|'.join(w)})\b")).alias(k) for k, w in families.items()])
    return out


def story_ranking(spark, sf_dir):
    """Extension: stories by a weighted score of topic relevance (.35), recency (.25), controversy (.15), diversity (.10) and performance (.15, 0 here)."""
    scores = topic_match_score(spark, sf_dir).select("pos", "relevance")
    rows = articles(spark, sf_dir).select("story_id", "pos", "bias", "outlet").join(scores, "pos")
    g = rows.groupBy("story_id").agg(F.avg("relevance").alias("topic"), F.max("pos").alias("latest"), F.count_if(F.col("bias") <= -2).alias("l"), F.count_if(F.col("bias") >= 2).alias("r"), F.count_distinct("outlet").alias("outlets"), F.count(F.lit(1)).alias("n"))
    g = g.crossJoin(F.broadcast(articles(spark, sf_dir).agg(F.max("pos").alias("last"))))  # one row on that side
    recency = F.col("latest") / F.greatest(F.col("last"), F.lit(1))
    score = 0.35 * F.col("topic") + 0.25 * recency + 0.15 * (2 * F.least("l", "r") / F.greatest(F.col("l") + F.col("r"), F.lit(1))) + 0.10 * (F.col("outlets") / F.col("n"))
    return g.select("story_id", F.round(score, 6).alias("score"))


QUERIES = {
    "bias_spread_by_story": (bias_spread_by_story, f"""select story_id, count(*) as n_sources, count(*) filter (bias <= -2) as left_count, count(*) filter (bias >= 2) as right_count,
        count(*) filter (bias <= -2) > 0 and count(*) filter (bias >= 2) > 0 as bias_spread_met from {ARTICLES} a group by story_id"""),
    "bias_distribution": (bias_distribution, f"""select story_id, count(*) filter (coalesce(bias, 0) < 0) as left_n, count(*) filter (coalesce(bias, 0) = 0) as center_n, count(*) filter (coalesce(bias, 0) > 0) as right_n,
        count(bias) as known_n from (select *, row_number() over (partition by story_id order by pos) as rn from {ARTICLES} a) where rn <= 20 group by story_id"""),
    "bias_label_lookup": (bias_label_lookup, f"""select pos, outlet, coalesce(bias, 0)::integer as bias, coalesce({LABEL_CASE}, 'Unknown') as bias_label, case when bias is null then 'unknown' else 'dataset' end as method,
        case when coalesce(bias, 0) < -2 then 'left' when coalesce(bias, 0) > 2 then 'right' when category = 'libertarian' then 'libertarian' when abs(coalesce(bias, 0)) <= 1 then 'balanced' else '' end as interpretation from {ARTICLES} a"""),
    "bias_comparison_sorted": (bias_comparison_sorted, f"""select story_id, pos, bias, row_number() over (partition by story_id order by bias, pos)::integer as rank from (
        select story_id, pos, coalesce(bias, 0)::integer as bias, row_number() over (partition by story_id order by pos) as rn from {ARTICLES} a) where rn <= 20"""),
    "balanced_sampler": (balanced_sampler, SAMPLER + " select story_id, pos, domain, coalesce(bias, 99)::integer as bias, kept_before from s"),
    "sources_by_story": (sources_by_story, SAMPLER + " select story_id, count(*) as n_sources, case when count(*) < 2 then 'too few sources' else '' end as error from s group by story_id"),
    "story_status": (story_status, SAMPLER + f""", n as (select story_id, count(*) as n from s group by story_id), f as (select story_id, arg_min(left(text, 100), pos) as title from {ARTICLES} a group by story_id)
        select f.story_id, f.title, case when coalesce(n.n, 0) >= 2 then 'analyzed' else 'failed' end as status from f left join n using (story_id)"""),
    "second_article_same_domain": (second_article_same_domain, f"""select a.story_id, a.pos, coalesce(min(b.pos), -1) as second_pos from {ARTICLES} a
        left join {ARTICLES} b on a.story_id = b.story_id and a.outlet = b.outlet and b.pos > a.pos where a.bias is null group by 1, 2"""),
    "bias_resolution_chain": (bias_resolution_chain, f"""with r as (select pos, bias, case when pos % 5 = 0 then (pos % 3 - 1) * 2 end as site, case when pos % 7 = 0 then least(greatest(pos % 11 - 5, -4), 4) end as model,
        {_present(text.LEFT_WORDS)} as l, {_present(text.RIGHT_WORDS)} as r from {ARTICLES} a)
        select pos, case when bias is not null then 'dataset' when site is not null then 'allsides' when model is not null then 'llm' else 'heuristic' end as method,
        coalesce(bias, site, model, case when l > r + 2 then -2 when r > l + 2 then 2 else 0 end)::integer as bias,
        case when bias is not null then 1.0 when site is not null then 0.6 when model is not null then 1.0 else 0.2 end::double as confidence from r"""),
    "facts_agreed": (_facts("l and r"), FACTS + "l = 1 and r = 1"),
    "facts_left_only": (_facts("l and not r"), FACTS + "l = 1 and r = 0"),
    "facts_right_only": (_facts("r and not l"), FACTS + "l = 0 and r = 1"),
    "topic_match_score": (topic_match_score, f"""select pos, found::integer as found, total::bigint as total, round(least(1.0, found / {len(TOPICS)} + total / 100), 6) as relevance from (
        select pos, {' + '.join(f'({_COUNT(t)} > 0)::integer' for t in TOPICS)} as found, {' + '.join(map(_COUNT, TOPICS))} as total from {ARTICLES} a)"""),
    "word_frequency_top5": (word_frequency_top5, f"""with w as (select pos, unnest(list_slice(regexp_extract_all(lower(text), '[a-z]{{4,}}'), 1, 500)) as word, generate_subscripts(list_slice(regexp_extract_all(lower(text), '[a-z]{{4,}}'), 1, 500), 1) as place from {ARTICLES} a),
        c as (select pos, word, count(*) as n, min(place) as first from w group by pos, word), r as (select *, row_number() over (partition by pos order by n desc, first) as rank from c)
        select pos, rank::integer as rank, word, n from r where rank <= 5"""),
    "lexicon_heuristic": (lexicon_heuristic, f"""select pos, l::integer as left_n, r::integer as right_n, case when l > r + 2 then -2 when r > l + 2 then 2 else 0 end::integer as bias from (
        select pos, {_present(text.LEFT_WORDS)} as l, {_present(text.RIGHT_WORDS)} as r from {ARTICLES} a)"""),
    "tokenize_set": (tokenize_set, f"""select pos, len(t)::integer as n_tokens, md5(array_to_string(list_sort(t), ' ')) as tokens_md5 from (
        select pos, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')), lambda x: not list_contains({dims.literal(text.TOKEN_STOP)}, x)) as t from {ARTICLES} a)"""),
    "bias_rollup": (bias_rollup, _GROUPED.format(what="count(*) as n_articles, sum(n)::bigint as chars", how="rollup")),
    "bias_cube": (bias_cube, _GROUPED.format(what="count(*) as n_articles", how="cube")),
    "rhetoric_markers": (rhetoric_markers, "select pos, count(*) as n_sentences, " + ", ".join(f"count(*) filter (regexp_matches(s, '\\b({'|'.join(w)})\\b')) as {k}" for k, w in (text.RHETORIC | {"frequent": ["the", "with", "that"]}).items())
        + f" from (select pos, unnest(regexp_split_to_array(lower(text), '[.!?\\n]+')) as s from {ARTICLES} a) where s <> '' group by pos"),
    "story_ranking": (story_ranking, f"""with t as (select pos, story_id, bias, outlet, round(least(1.0, ({' + '.join(f'({_COUNT(t)} > 0)::integer' for t in TOPICS)}) / {len(TOPICS)} + ({' + '.join(map(_COUNT, TOPICS))}) / 100), 6) as rel from {ARTICLES} a),
        g as (select story_id, avg(rel) as topic, max(pos) as latest, count(*) filter (bias <= -2) as l, count(*) filter (bias >= 2) as r, count(distinct outlet) as outlets, count(*) as n from t group by story_id)
        select story_id, round(0.35 * topic + 0.25 * (latest / greatest(max(latest) over (), 1)) + 0.15 * (2 * least(l, r) / greatest(l + r, 1)) + 0.10 * (outlets / n), 6) as score from g"""),
}
