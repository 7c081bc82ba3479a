"""Bias ratings: labels, notes, and what web pages and models answer."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswire.dims import BIAS_LABELS, SITE_LABELS
from presswire.functions.text import clean_summary

LABEL_PATTERN = r"bias\s+rating[^a-z]*(far left|left|lean left|center|lean right|right|far right|mixed|not rated)"


def label(bias: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain(*BIAS_LABELS.items())])
    return F.coalesce(F.try_element_at(table, bias.cast("int")), F.lit("Unknown"))


def interpretation(bias: Column, category: Column) -> Column:
    return (
        F.when(bias < -2, "left")
        .when(bias > 2, "right")
        .when(F.coalesce(category, F.lit("")) == "libertarian", "libertarian")
        .when(F.abs(bias) <= 1, "balanced")
    )


def detail_path(html: Column) -> Column:
    """Where a rating site's search page leads: its first rating link, else its first source link."""
    link = lambda kind: F.nullif(F.regexp_extract(html, rf'(?i)href="(/{kind}/[^"?]+)"', 1), F.lit(""))
    return F.coalesce(link("media-bias"), link("news-source"))


def site_label(html: Column) -> Column:
    """The label that follows 'bias rating' (null if not rated), else the first label of SITE_LABELS found anywhere.

    As 'left' is looked for before 'lean left' and 'right' before 'far right', the latter are never found that way.
    """
    text = F.lower(clean_summary(html))
    near = F.nullif(F.regexp_extract(text, LABEL_PATTERN, 1), F.lit(""))
    anywhere = F.coalesce(*[F.when(text.contains(name), F.lit(name)) for name, _ in SITE_LABELS])
    return F.when(near == "not rated", F.lit(None)).otherwise(F.coalesce(near, anywhere))


def site_score(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain(*SITE_LABELS)])
    return F.when(name.isNotNull(), F.coalesce(F.try_element_at(table, name), F.lit(0)))


def model_answer(reply: Column) -> Column:
    """struct(bias, confidence) of a model's reply: its first {...}; bias within -4..4, confidence within 0..1, defaults 0 and 0.5.

    Null if there is no object or it is not JSON.
    """
    found = F.nullif(F.regexp_extract(reply, r"\{[^}]+\}", 0), F.lit(""))
    data = F.from_json(found, "bias double, confidence double")
    bias = F.greatest(F.least(F.coalesce(data["bias"], F.lit(0.0)).cast("int"), F.lit(4)), F.lit(-4))
    sure = F.greatest(F.least(F.coalesce(data["confidence"], F.lit(0.5)), F.lit(1.0)), F.lit(0.0))
    return F.when(F.try_parse_json(found).isNotNull() & data.isNotNull(), F.struct(bias.alias("bias"), sure.alias("confidence")))
