"""Structured Streaming forms of the counts that grow with a history. The reference engine has no streams; these extend AG3, AG4 and AG7."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_activity(events: DataFrame, ts: str = "ts", key: str = "event_type", length: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts by tumbling (or sliding) window and key; rows later than ``late`` are dropped with their window's state."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return (
        events.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, late)
        .groupBy(w.alias("w"), key)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
    )


def sessions(events: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Bursts of activity: windows that close after ``gap`` without an event of the key."""
    return (
        events.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, late)
        .groupBy(F.session_window(ts, gap).alias("w"), key)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
    )


def running_modify_counts(touched: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """AG7 as a running total by node; a (commit, node) that comes twice within ``late`` counts once."""
    once = touched.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(["commit", "node"])
    return once.groupBy("node").agg(F.count("*").alias("modify_count"))
