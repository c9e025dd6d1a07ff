"""Streaming windows: tumbling, sliding and session aggregates with watermarks, as the batch windows have them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, time: str, every: str, aggregates: list[Column], period: str | None = None, by: list[str] | None = None, late: str = "10 minutes") -> DataFrame:
    """Aggregates over windows of a stream; rows later than `late` behind the newest are dropped."""
    window = F.window(time, period or every, every)
    grouped = stream.withWatermark(time, late).groupBy(window.alias("w"), *(by or []))
    out = grouped.agg(*aggregates)
    return out.select(*(by or []), F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c not in ("w", *(by or []))])


def sessions(stream: DataFrame, time: str, gap: str, by: list[str], aggregates: list[Column], late: str = "10 minutes") -> DataFrame:
    """Aggregates over sessions: runs of rows of one key that are at most `gap` apart."""
    grouped = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by)
    out = grouped.agg(*aggregates)
    return out.select(*by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in out.columns if c not in ("w", *by)])
