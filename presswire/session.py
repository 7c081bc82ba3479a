"""A Spark session with the settings the engine assumes."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def build(app: str = "presswire", **conf: str) -> SparkSession:
    """UTC and adaptive execution; ANSI mode stays on, so ingest uses try_* functions. Size partitions for the cluster through conf."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false"} | conf
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def with_package(spark: SparkSession, rows: int = 1000) -> None:
    """Ready the session for Python stages.

    Local Python workers can import this package even when only the driver's sys.path has it (clusters use --py-files). A batch for
    a worker has at most `rows` rows: it is held several times over, by the executor and by the worker, and texts are long. The setting
    stays, since plans read it when they run; a session with a lower one keeps that.
    """
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= rows:
        spark.conf.set(ARROW_ROWS, rows)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
