"""Streaming extension: sequence features of unbounded events. Batch and stream share the plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_counts(events: DataFrame, key: str, time: str, gap: str, late: str = "1 hour") -> DataFrame:
    """(key, session_start, session_end, n): sessions split by `gap`; rows later than `late` behind are dropped by the watermark in a stream."""
    on = events.withWatermark(time, late) if events.isStreaming else events
    out = on.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def label_counts(events: DataFrame, time: str, label: str, window: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(window_start, label, n) by tumbling or sliding windows."""
    on = events.withWatermark(time, late) if events.isStreaming else events
    out = on.groupBy(F.window(time, window, slide) if slide else F.window(time, window), label).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("window_start"), label, "n")
