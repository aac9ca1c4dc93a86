"""Windowed and session counts over event streams; ``operators.feed.follow`` processes changes as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, late: str = "1 day", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) per window, on streams and tables alike; a stream drops rows later than ``late``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, n): events of a user no further apart than ``gap``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
