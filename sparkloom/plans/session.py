"""A session with the settings the engine is tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI, adaptive execution; a local master gets as many shuffle partitions as given (8)."""
    builder = SparkSession.builder.master(master).appName("sparkloom")
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": str(partitions or 8)}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
