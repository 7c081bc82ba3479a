"""Model catalogues of the providers, normalised to one shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswire.functions import models, text

REPLY = (
    "data array<struct<id:string,name:string,display_name:string,pricing:struct<prompt:string,completion:string>,context_length:bigint,context_window:bigint,max_tokens:bigint,description:string>>,"
    "models array<struct<slug:string,id:string,name:string,display_name:string>>"
)
# Providers whose models count as free.
FREE = ["mistral", "groq", "cerebras", "sambanova", "lmstudio", "ollama"]
NAMES_FROM_ID = ["gemini", "mistral", "groq", "cerebras"]


def scan(replies: DataFrame, provider: str) -> DataFrame:
    """Replies (provider, json) of one provider: pos, id, name, provider, is_free, costs per million, context_length, description. No id: dropped."""
    own = replies.where(F.col("provider") == provider).select(F.from_json("json", REPLY).alias("r"))
    listed = F.col("r.models") if provider == "ollama" else F.col("r.data")
    rows = own.select(F.posexplode(listed).alias("pos", "m"))
    raw = text.first_of(F.col("m.id"), F.col("m.name"))
    name = raw if provider in NAMES_FROM_ID else F.coalesce(F.col("m.display_name"), F.col("m.name"), raw)
    key = models.model_for_provider(F.lit(provider), raw)
    if provider == "ollama":
        return rows.select("pos", key.alias("id"), name.alias("name"), F.lit(provider).alias("provider"), F.lit(True).alias("is_free"), F.lit(0.0).alias("input_cost_per_m"), F.lit(0.0).alias("output_cost_per_m"), F.lit(0).cast("bigint").alias("context_length"), F.lit("").alias("description")).where("id <> ''")
    if provider == "openrouter":
        cost = [models.price_per_million(F.col(f"m.pricing.{k}")) for k in ("prompt", "completion")]
    else:
        cost = [F.lit(0.0), F.lit(0.0)]
    free = (cost[0] == 0) & (cost[1] == 0) if provider == "openrouter" else F.lit(provider in FREE)
    size = F.coalesce(F.nullif(F.col("m.context_window"), F.lit(0)), F.col("m.context_length"), F.col("m.max_tokens"), F.lit(0))
    return rows.select("pos", key.alias("id"), name.alias("name"), F.lit(provider).alias("provider"), free.alias("is_free"), cost[0].alias("input_cost_per_m"), cost[1].alias("output_cost_per_m"), size.alias("context_length"), F.coalesce("m.description", F.lit("")).alias("description")).where("id <> ''")


def scan_all(replies: DataFrame, providers: list[str]) -> DataFrame:
    """All given providers' models; a provider whose reply is no JSON adds none."""
    return reduce(DataFrame.unionByName, [scan(replies, p) for p in providers])


def command_line(replies: DataFrame) -> DataFrame:
    """The local command's list: id is slug or id, name is display_name or id; without id dropped."""
    rows = replies.select(F.posexplode(F.from_json("json", REPLY)["models"]).alias("pos", "m"))
    key = text.first_of(F.col("m.slug"), F.col("m.id"))
    return rows.select("pos", key.alias("id"), F.coalesce(F.nullif(F.col("m.display_name"), F.lit("")), key).alias("name")).where("id is not null")


def recovery_order(catalogue: DataFrame) -> DataFrame:
    """id, tier, rank of replacement models: openrouter/free, free text models, free models, all; by id inside a tier, each id once."""
    every = F.array(
        F.when(F.col("id") == "openrouter/free", 0),
        F.when(F.col("is_free") & models.is_text_model(F.col("id")), 1),
        F.when(F.col("is_free"), 2),
        F.lit(3),
    )
    return catalogue.where("id <> ''").groupBy("id").agg(F.min(F.array_min(every)).alias("tier"))


def in_order(catalogue: DataFrame) -> DataFrame:
    """A provider's models with their rank by id (code points), as lists show them."""
    return catalogue.withColumn("rank", F.row_number().over(Window.partitionBy("provider").orderBy("id")))


def configured(providers: DataFrame, keys: DataFrame) -> DataFrame:
    """Of providers (provider, key) those whose key is among the set ones (key), and those that need none (null)."""
    return providers.join(keys, "key", "left_semi").select("provider").unionByName(providers.where("key is null").select("provider"))


def refreshed(cache: DataFrame, fetched: DataFrame, now: Column, seconds: int = 3600) -> DataFrame:
    """provider, model, state of a cache (provider, model, at) and what was fetched (provider, model): entries younger than `seconds` stand
    (cached), older ones are replaced by their provider's fetched ones, or stay (stale) if it has none."""
    cache = cache.withColumn("fresh", now - F.col("at") < seconds)
    new = fetched.join(cache.where("fresh").select("provider").distinct(), "provider", "left_anti")
    old = cache.join(new.select("provider").distinct(), "provider", "left_anti")
    return new.select("provider", "model", F.lit("fetched").alias("state")).unionByName(old.select("provider", "model", F.when(F.col("fresh"), "cached").otherwise("stale").alias("state")))
