"""Model ids, prices, errors and retry times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswire.dims import PROVIDERS

# Parts of ids of models that are not for text.
NOT_TEXT = ["vision", "-vl", "_vl", "image", "audio", "video", "speech"]
# What rate-limit errors say, to the router and to the service.
ROUTER_MARKS = ["resource_exhausted", "rate_limited", "rate limit", "rate_limit", "over capacity", "service unavailable", "internal_server_error", "429"]
SERVICE_MARKS = ["ratelimiterror", "rate limit", "rate_limited", "resource_exhausted", "too many requests", "429"]
NOT_FOUND_MARKS = ["notfounderror", "openrouterexception", "no endpoints found"]
BASE_DELAY, MAX_DELAY, RETRIES = 5, 120, 5


def provider_name(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return F.when(low == "xai", "grok").when(low.isin("lm_studio", "lm-studio"), "lmstudio").otherwise(low)


def model_for_provider(provider: Column, model: Column) -> Column:
    """The id without its provider's own prefixes, however often they come; other prefixes stay."""
    name, out = provider_name(provider), F.trim(F.coalesce(model, F.lit("")))
    stripped = out
    for key, prefixes, _, _ in PROVIDERS:
        cut = F.regexp_replace(out, f"(?i)^(?:(?:{'|'.join(prefixes)})/)+", "")
        if key == "gemini":
            cut = F.regexp_replace(cut, "(?i)^(?:models/)+", "")
        stripped = F.when(name == key, cut).otherwise(stripped)
    return stripped


def call_name(provider: Column, model: Column) -> Column:
    """prefix/model, as the completion library takes it; unknown providers count as openai."""
    prefix = F.lit("openai")
    for key, _, call, _ in PROVIDERS:
        prefix = F.when(provider_name(provider) == key, call).otherwise(prefix)
    return F.concat(prefix, F.lit("/"), model_for_provider(provider, model))


def bridge_model(model: Column) -> Column:
    """One openai/ or codex/ prefix taken off."""
    return F.regexp_replace(F.trim(model), r"(?i)^(openai|codex)/", "")


def price_per_million(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0)) * 1_000_000


def price_text(cost: Column) -> Column:
    """Four decimals, trailing zeros and point trimmed."""
    return F.regexp_replace(F.format_string("%.4f", cost), r"\.?0+$", "")


def price_label(name: Column, provider: Column, input_cost: Column, output_cost: Column) -> Column:
    """Only openrouter shows prices: Free when both are 0."""
    free = (input_cost == 0) & (output_cost == 0)
    shown = F.when(free, F.concat(name, F.lit(" (Free)"))).otherwise(F.concat(name, F.lit(" ($"), price_text(input_cost), F.lit("/$"), price_text(output_cost), F.lit(" per 1M)")))
    return F.when(provider == "openrouter", shown).otherwise(name)


def is_text_model(model: Column) -> Column:
    low, out = F.lower(model), F.lit(True)
    for part in NOT_TEXT:
        out = out & ~low.contains(part)
    return out


def is_free(provider: Column, model: Column) -> Column:
    return F.lower(model).contains(":free") | provider.isin("ollama", "lmstudio")


def _says(message: Column, marks: list[str]) -> Column:
    low, out = F.lower(message), F.lit(False)
    for m in marks:
        out = out | low.contains(m)
    return out


def router_rate_limited(status: Column, message: Column) -> Column:
    return F.coalesce(status.isin(429, 503), F.lit(False)) | _says(message, ROUTER_MARKS)


def service_rate_limited(message: Column, error_class: Column) -> Column:
    return _says(message, SERVICE_MARKS) | F.lower(error_class).contains("ratelimit")


def quota_zero(message: Column) -> Column:
    return message.rlike(r"(?i)limit:\s*0")


def model_not_found(provider: Column, message: Column) -> Column:
    return (provider == "openrouter") & _says(message, NOT_FOUND_MARKS)


def retry_after(message: Column) -> Column:
    """Whole seconds only: times with decimals are not read."""
    return F.nullif(F.regexp_extract(message, r"(?i)retry in ([0-9]+)s", 1), F.lit("")).cast("double")


def backoff(attempt: Column, message: Column) -> Column:
    return F.least(F.greatest(BASE_DELAY * F.pow(F.lit(2.0), attempt), F.coalesce(retry_after(message), F.lit(0.0))), F.lit(float(MAX_DELAY)))


def temperature(model: Column, override: Column, given: Column) -> Column:
    """gpt-5 models take 1.0 alone; else the override, the argument, 0.7."""
    return F.when(F.lower(model).startswith("gpt-5"), 1.0).otherwise(F.coalesce(override, given, F.lit(0.7)))


def http_status(error: Column) -> Column:
    return (
        F.when(error == "source_extraction", 422)
        .when(error == "rate_limit", 429)
        .when(error == "budget", 402)
        .when(error == "not_found", 404)
        .when(error == "bad_request", 400)
        .otherwise(500)
    )


# Providers whose completions the agents' library calls itself.
NATIVE_PROVIDERS = ["openai", "anthropic", "gemini", "azure", "azure_openai", "bedrock", "aws"]
# Spellings of the debug setting.
DEBUG_OFF, DEBUG_ON = ["release", "prod", "production"], ["debug", "dev", "development"]
EFFORTS = ["low", "medium", "high"]


def split_llm(llm: Column) -> Column:
    """struct(provider, model) of provider/model; what is missing is unknown, and all of a name without slash is the model."""
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    split = F.coalesce(llm.contains("/"), F.lit(False))
    provider = F.when(split, known(F.split_part(llm, F.lit("/"), F.lit(1)))).otherwise("unknown")
    return F.struct(provider.alias("provider"), F.when(split, known(F.regexp_replace(llm, r"^[^/]*/", ""))).otherwise(known(llm)).alias("model"))


def found(term: Column, model: Column, label: Column) -> Column:
    """The search term, trimmed and in any case, is part of the label (the id without one) or of the id."""
    low = F.lower(F.trim(term))
    return F.lower(F.coalesce(F.nullif(label, F.lit("")), model)).contains(low) | F.lower(model).contains(low)


def takes_effort(provider: Column, model: Column) -> Column:
    """Whether a model is offered with a reasoning effort."""
    return (provider == "openai") & model.rlike(r"(?i)^(gpt-|o\d|o-|codex)")


def passed_effort(provider: Column, effort: Column) -> Column:
    """The effort that is passed on; null if none is."""
    return F.when((provider == "openai") & effort.isin(EFFORTS), effort)


def debug_setting(value: Column) -> Column:
    """false and true for their other spellings; anything else stays."""
    low = F.lower(F.trim(value))
    return F.when(low.isin(DEBUG_OFF), "false").when(low.isin(DEBUG_ON), "true").otherwise(value)


def fallback(provider: Column, local: str = "lmstudio", model: str = "lm_studio/phi-4") -> Column:
    """The local model's call name for providers that are neither native nor local; null for these."""
    return F.when(~provider.isin([*NATIVE_PROVIDERS, local]), call_name(F.lit(local), F.lit(model)))
