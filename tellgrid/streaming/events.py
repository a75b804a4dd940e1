"""Windows over events: the same function serves a batch and a stream (an extension; the source engine has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, length: str, watermark: str | None = None) -> DataFrame:
    """start, event_type, n, total of fixed windows; ``watermark`` bounds the state of a stream."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    grouped = events.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """user_id, start, n of sessions that end after ``gap`` without an event."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    grouped = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), "n")


def once_per_event(events: DataFrame, key: str = "event_id", watermark: str = "10 minutes") -> DataFrame:
    """Each event once, with state for as long as the watermark only."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])
