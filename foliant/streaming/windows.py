"""Event-time windows; the same expressions serve batch tables and streams (with a watermark)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(events: DataFrame, delay: str | None) -> DataFrame:
    return events.withWatermark("ts", delay) if delay and events.isStreaming else events


def tumbling(events: DataFrame, size: str, delay: str | None = "1 hour") -> DataFrame:
    return _late(events, delay).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, size: str, step: str, delay: str | None = "1 hour") -> DataFrame:
    return _late(events, delay).groupBy(F.window("ts", size, step), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, key: str, gap: str, delay: str | None = "1 hour") -> DataFrame:
    return _late(events, delay).groupBy(key, F.session_window("ts", gap).alias("window")).agg(F.count(F.lit(1)).alias("n"))
