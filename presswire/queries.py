"""All registered queries of the engine but the corpus operators'."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from presswire.catalog import articles, columns, feeds, lookups, stored, stories, streams, tables, tools

_ALL = stories.QUERIES | feeds.QUERIES | lookups.QUERIES | tables.QUERIES | tools.QUERIES | streams.QUERIES | stored.QUERIES | articles.QUERIES | columns.QUERIES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: run for name, (run, _) in _ALL.items()}
ORACLES: dict[str, str] = {name: sql for name, (_, sql) in _ALL.items() if sql}
