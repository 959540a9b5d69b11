"""A session with the settings the retail jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "bazaarlake", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; further settings by keyword (``spark_sql_shuffle_partitions="400"``)."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
