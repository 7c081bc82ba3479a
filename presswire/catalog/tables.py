"""Queries over events, conversations and the star schema: budgets, prompts, stored rows, patches."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswire import dims
from presswire.operators import budget, scan, store

# The lines that open a prompt.
HEAD = ["You are responding through an OpenAI-compatible local bridge.", "Answer the final user request using the conversation below."]
MAX_PROMPT = 2000
LIMIT = 100.0


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_spend(spark, sf_dir):
    out = budget.daily(read(spark, sf_dir, "events"), "ts", "value")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("amount", 4).alias("amount"), "n_spends")


def budget_running_check(spark, sf_dir):
    """Per user and day (so that no window holds a whole day): purchases are free models, odd days have a limit."""
    rows = read(spark, sf_dir, "events").withColumns({"day": F.to_date("ts"), "cost": F.floor(F.col("value") * 100)})
    limit = F.when(F.dayofmonth("day") % 2 == 1, LIMIT * 100).otherwise(0.0)
    out = budget.affordable(rows, ["user_id", "day"], ["ts", "event_id"], "cost", limit, F.col("event_type") == "purchase")
    return out.select("event_id", F.col("spent_before").cast("long").alias("spent_before"), "allowed")


def daily_budget_check(spark, sf_dir):
    """Per day, as the tracker counts: however many events a day has, its running sum is scanned by many tasks."""
    rows = read(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.to_date("ts").alias("day"), F.floor(F.col("value") * 100).alias("cost"))
    out = budget.affordable(rows, ["day"], ["ts", "event_id"], "cost", F.lit(LIMIT * 1000), F.col("event_type") == "purchase")
    return out.select("event_id", F.col("spent_before").cast("long").alias("spent_before"), "allowed")


def provider_pacing(spark, sf_dir):
    """Calls of few providers (event types), each of which holds a large part of all rows: starts a minute apart."""
    rows = read(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    out = scan.spaced(rows, ["event_type"], ["ts", "event_id"], F.unix_micros(F.col("ts").cast("timestamp")), 60_000_000, "starts")
    return out.select("event_id", "starts")


def events_since_signup(spark, sf_dir):
    """Each event with the last signup of its type's week before it: the nearest heading above a line, over keys of any size."""
    rows = read(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"))
    out = scan.running(rows, ["week"], ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), "last", "signup_id")
    return out.select("event_id", F.coalesce("signup_id", F.lit(-1)).alias("signup_id"))


def task_times(spark, sf_dir):
    """signup starts a task of its user; click ends it, error fails it."""
    out = budget.task_times(read(spark, sf_dir, "events"), ["user_id"], "ts", "event_type", "signup", ["click", "error"])
    return out.select("event_id", "event_type", F.coalesce(F.floor(F.col("micros") / 1_000_000), F.lit(-1)).alias("seconds"))


def prompts(spark, sf_dir):
    """Conversations flattened to a prompt: blank messages left out, roles in title case."""
    rows = read(spark, sf_dir, "conversations").where(F.trim(F.coalesce("text", F.lit(""))) != "")
    block = F.concat(F.initcap("role"), F.lit(":\n"), F.regexp_replace("text", r"^\s+|\s+$", ""))
    parts = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("parts"))
    return parts.select("conv_id", F.concat_ws("\n\n", *map(F.lit, HEAD), F.array_join(F.transform("parts", lambda p: p["b"]), "\n\n")).alias("prompt"))


def message_prompt_flatten(spark, sf_dir):
    return prompts(spark, sf_dir).select("conv_id", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


def prompt_length_guard(spark, sf_dir):
    n = F.length("prompt")
    return prompts(spark, sf_dir).select("conv_id", F.when(n > MAX_PROMPT, F.concat(F.lit("Prompt is "), n.cast("string"), F.lit(f" characters; limit is {MAX_PROMPT}."))).otherwise("").alias("error"))


PROMPTS = f"""(select conv_id, {' || chr(10) || chr(10) || '.join(map(dims.literal, HEAD))} || chr(10) || chr(10) || string_agg(upper(role[1]) || lower(role[2:]) || ':' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) order by turn) as prompt
  from conversations where trim(coalesce(text, '')) <> '' group by conv_id)"""


def spend_rank(spark, sf_dir):
    """Users' total spend with dense rank and share: top 20."""
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.floor(budget.counted(F.col("value")) * 100)).alias("cents"))
    top = rows.orderBy(F.desc("cents"), "user_id").limit(20)
    return top.select("user_id", F.col("cents").cast("long").alias("cents"), F.dense_rank().over(Window.orderBy(F.desc("cents"))).alias("rank"))


# Orders stand for stories, their lines for sources, customers for channels.
def recent_stories(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return rows.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def story_with_analysis(spark, sf_dir):
    """Stories with their sources (inner) and, for most, an analysis (left): sums by status."""
    stories, sources = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    analyses = stories.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("a_key"), F.floor("o_totalprice").alias("size"))
    n = sources.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_sources"))
    rows = stories.join(n, F.col("o_orderkey") == F.col("l_orderkey")).join(analyses, F.col("o_orderkey") == F.col("a_key"), "left")
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_stories"), F.sum("n_sources").alias("n_sources"), F.count("a_key").alias("n_analyzed"), F.sum("size").cast("long").alias("size"))


def performance_referential_check(spark, sf_dir):
    """Performance rows (events) whose story (order) exists, and the number that would be refused."""
    rows = read(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("o_orderkey"))
    stories = read(spark, sf_dir, "orders").select("o_orderkey").where("o_orderkey % 2 = 0")
    kept = rows.join(stories, "o_orderkey", "left_semi").select("event_id", F.lit("accepted").alias("state"))
    refused = store.orphans(rows, stories, "o_orderkey", "o_orderkey").select("event_id", F.lit("refused").alias("state"))
    return kept.unionByName(refused)


def performance_patch(spark, sf_dir):
    """Sparse update: new values where given, else the old ones; new keys are added."""
    old = read(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("story_id"), F.col("c_nationkey").alias("likes"), F.floor("c_acctbal").alias("views"))
    new = read(spark, sf_dir, "customer").where("c_custkey % 5 < 2").select(F.col("c_custkey").alias("story_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey") + 100).alias("likes"), F.lit(None).cast("bigint").alias("views"))
    return store.patch(old, new, "story_id")


# The agents' roles.
ROLES = [
    "profile_reader", "news_aggregator", "relevance_scorer", "story_parser", "source_aggregator", "bias_classifier", "fact_extractor", "rhetorical_analyst", "narrative_analyzer", "report_writer",
]
CONFIGS = [("fact_extractor", "xai", "grok/grok-2", True, "high"), ("bias_classifier", "gemini", "models/g", False, None), ("report_writer", "openai", "gpt-5", False, "low")]
CONFIG_SCHEMA = "agent_name string, provider string, model string, free_tier boolean, reasoning_effort string"


def configs(spark):
    return spark.createDataFrame(CONFIGS, CONFIG_SCHEMA)


def agent_config_left_join(spark, sf_dir):
    roles = spark.createDataFrame([(r,) for r in ROLES], "agent_name string")
    out = roles.join(F.broadcast(configs(spark)), "agent_name", "left")
    return out.select("agent_name", F.coalesce("provider", F.lit("")).alias("provider"), F.coalesce("free_tier", F.lit(False)).alias("free_tier"))


def missing_roles_anti(spark, sf_dir):
    return spark.createDataFrame([(r,) for r in ROLES], "agent_name string").join(configs(spark), "agent_name", "left_anti")


def config_backfill(spark, sf_dir):
    """Missing roles get the fact extractor's row as template, normalised; a second run adds none."""
    from presswire.functions import models

    roles = spark.createDataFrame([(r,) for r in ROLES], "agent_name string")
    once = store.backfill(configs(spark), roles, "agent_name", ["fact_extractor", "report_writer"], ["provider", "model", "free_tier"])
    twice = store.backfill(once, roles, "agent_name", ["fact_extractor", "report_writer"], ["provider", "model", "free_tier"])
    return twice.select("agent_name", models.provider_name(F.col("provider")).alias("provider"), models.model_for_provider(F.col("provider"), F.col("model")).alias("model"), "free_tier", F.coalesce("reasoning_effort", F.lit("")).alias("reasoning_effort"))


def config_patch_upsert(spark, sf_dir):
    changes = spark.createDataFrame([("fact_extractor", None, "grok-3", None, True), ("editor", "groq", "m", False, False), ("report_writer", None, None, True, False)], "agent_name string, provider string, model string, free_tier boolean, clear_effort boolean")
    out = store.patch(configs(spark), changes.withColumn("reasoning_effort", F.lit(None).cast("string")), "agent_name", {"reasoning_effort": "clear_effort"})
    return out.select("agent_name", "provider", "model", F.coalesce("free_tier", F.lit(False)).alias("free_tier"), F.coalesce("reasoning_effort", F.lit("")).alias("reasoning_effort"))


def schema_migration(spark, sf_dir):
    """Columns added with defaults; running it again changes nothing."""
    old = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    new = store.add_columns(store.add_columns(old, {"free_tier": False, "reasoning_effort": ""}), {"free_tier": True})
    return new.groupBy("free_tier", "reasoning_effort").agg(F.count(F.lit(1)).alias("n"))


def cascade_delete(spark, sf_dir):
    """Stories of a nation go with their sources; counts of what is left."""
    parents, children = read(spark, sf_dir, "customer").select("c_custkey"), {"orders": read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_fk"))}
    gone = read(spark, sf_dir, "customer").where("c_nationkey = 7").select("c_custkey")
    kept, left = store.cascade_delete(parents, children, gone, "c_custkey", "c_fk")
    return kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit("parents").alias("what"), "n").unionByName(left["orders"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("children").alias("what"), "n"))


def unique_violations(spark, sf_dir):
    """Stories with a second analysis: orders' customers that occur more than once."""
    return store.violations(read(spark, sf_dir, "orders"), "o_custkey")


def label_accuracy(spark, sf_dir):
    """Manual quality labels against a length rule, by outlet."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", (F.length("text") >= 200).cast("int").alias("said"))
    rows = docs.join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("said") == F.col("quality")).alias("right_n"))


def props_json(spark, sf_dir):
    """JSON properties by event type."""
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count_distinct(k).alias("k_distinct"))


_CFG = dims.values_sql(CONFIGS, "agent_name, provider, model, free_tier, reasoning_effort")
_ROLES = dims.values_sql([(r,) for r in ROLES], "agent_name")

QUERIES = {
    "daily_spend": (daily_spend, "select strftime(ts, '%Y-%m-%d') as day, round(sum(case when value > 0 then value else 0 end), 4) as amount, count(*) filter (value > 0) as n_spends from events group by 1"),
    "budget_running_check": (budget_running_check, f"""with e as (select *, ts::date as day, floor(value * 100)::bigint as cost from events),
        s as (select *, coalesce(sum(greatest(cost, 0)) over (partition by user_id, day order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as before, case when day(day) % 2 = 1 then {LIMIT * 100} else 0 end as lim from e)
        select event_id, before::bigint as spent_before, case when lim <= 0 then event_type = 'purchase' else event_type = 'purchase' or before < lim end as allowed from s"""),
    "daily_budget_check": (daily_budget_check, f"""with e as (select *, ts::date as day, floor(value * 100)::bigint as cost from events),
        s as (select *, coalesce(sum(greatest(cost, 0)) over (partition by day order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as before from e)
        select event_id, before::bigint as spent_before, event_type = 'purchase' or before < {LIMIT * 1000} as allowed from s"""),
    "provider_pacing": (provider_pacing, """with p as (select *, row_number() over (partition by event_type order by ts, event_id) as i from events)
        select event_id, max(epoch_us(ts) - i * 60000000) over (partition by event_type order by ts, event_id rows unbounded preceding) + i * 60000000 as starts from p"""),
    "events_since_signup": (events_since_signup, """select event_id, coalesce(last_value(case when event_type = 'signup' then event_id end ignore nulls)
        over (partition by date_trunc('week', ts) order by ts, event_id rows unbounded preceding), -1) as signup_id from events"""),
    "task_times": (task_times, """with e as (select *, lag(event_type) over w as pt, lag(ts) over w as pts from events where event_type in ('signup', 'click', 'error') window w as (partition by user_id order by ts, event_id))
        select event_id, event_type, case when pt = 'signup' then floor((epoch_us(ts) - epoch_us(pts)) / 1000000)::bigint else -1 end as seconds from e where event_type in ('click', 'error')"""),
    "message_prompt_flatten": (message_prompt_flatten, f"select conv_id, length(prompt)::integer as n_chars, md5(prompt) as prompt_md5 from {PROMPTS} p"),
    "prompt_length_guard": (prompt_length_guard, f"select conv_id, case when length(prompt) > {MAX_PROMPT} then 'Prompt is ' || length(prompt) || ' characters; limit is {MAX_PROMPT}.' else '' end as error from {PROMPTS} p"),
    "spend_rank": (spend_rank, """with u as (select user_id, sum(floor(case when value > 0 then value else 0 end * 100))::bigint as cents from events group by user_id order by cents desc, user_id limit 20)
        select user_id, cents, dense_rank() over (order by cents desc)::integer as rank from u"""),
    "recent_stories": (recent_stories, "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders where o_orderstatus = 'O' order by o_orderdate desc, o_orderkey limit 25"),
    "story_with_analysis": (story_with_analysis, """select o_orderstatus, count(*) as n_stories, sum(n)::bigint as n_sources, count(*) filter (o_orderkey % 3 <> 0) as n_analyzed, (sum(floor(o_totalprice)) filter (o_orderkey % 3 <> 0))::bigint as size
        from orders join (select l_orderkey, count(*) as n from lineitem group by 1) on o_orderkey = l_orderkey group by 1"""),
    "performance_referential_check": (performance_referential_check, "select event_id, case when event_id in (select o_orderkey from orders where o_orderkey % 2 = 0) then 'accepted' else 'refused' end as state from events"),
    "performance_patch": (performance_patch, """with o as (select c_custkey as story_id, c_nationkey as likes, floor(c_acctbal)::bigint as views from customer where c_custkey % 3 <> 0),
        n as (select c_custkey as story_id, case when c_custkey % 2 = 0 then c_nationkey + 100 end as likes, null::bigint as views from customer where c_custkey % 5 < 2)
        select coalesce(o.story_id, n.story_id) as story_id, coalesce(n.likes, o.likes)::integer as likes, coalesce(n.views, o.views) as views from o full outer join n on o.story_id = n.story_id"""),
    "agent_config_left_join": (agent_config_left_join, f"select r.agent_name, coalesce(provider, '') as provider, coalesce(free_tier, false) as free_tier from {_ROLES} r left join {_CFG} c on r.agent_name = c.agent_name"),
    "missing_roles_anti": (missing_roles_anti, f"select agent_name from {_ROLES} r where agent_name not in (select agent_name from {_CFG} c)"),
    "config_backfill": (config_backfill, "select * from " + dims.values_sql(
        [(r, "grok", "grok-2", True, "high" if r == "fact_extractor" else "") for r in ROLES if r not in ("bias_classifier", "report_writer")] + [("bias_classifier", "gemini", "g", False, ""), ("report_writer", "openai", "gpt-5", False, "low")], "agent_name, provider, model, free_tier, reasoning_effort")),
    "config_patch_upsert": (config_patch_upsert, "select * from " + dims.values_sql([("fact_extractor", "xai", "grok-3", True, ""), ("bias_classifier", "gemini", "models/g", False, ""), ("report_writer", "openai", "gpt-5", True, "low"), ("editor", "groq", "m", False, "")], "agent_name, provider, model, free_tier, reasoning_effort")),
    "schema_migration": (schema_migration, "select false as free_tier, '' as reasoning_effort, count(*) as n from supplier"),
    "cascade_delete": (cascade_delete, "select 'parents' as what, count(*) as n from customer where c_nationkey <> 7 union all select 'children', count(*) from orders where o_custkey not in (select c_custkey from customer where c_nationkey = 7)"),
    "unique_violations": (unique_violations, "select o_custkey, count(*) as n from orders group by 1 having count(*) > 1"),
    "label_accuracy": (label_accuracy, "select source, count(*) as n, count(*) filter ((length(text) >= 200)::integer = quality) as right_n from documents join labels using (doc_id) group by source"),
    "props_json": (props_json, "select event_type, sum(json_extract(props, '$.k')::integer)::bigint as k_sum, count(distinct json_extract(props, '$.k')::integer) as k_distinct from events group by 1"),
}
