"""A Spark session with the settings that the engine's results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "textloom", master: str | None = None, **options: str) -> SparkSession:
    """UTC times, adaptive plans with skewed joins split, Arrow between the JVM and Python. Options are added as they are."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (settings | options).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
