"""Structured Streaming over behaviour events: labels as they come, windows with late data, and running memory counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.scalar import interaction_label


def label_stream(events: DataFrame) -> DataFrame:
    """Labels are a projection: the same function as in batch."""
    return events.withColumn("label", interaction_label(F.col("hate"), F.col("value"), [F.col("action")]))


def windowed_counts(events: DataFrame, time: str = "ts", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and value by type and window; windows close when the watermark passes."""
    w = events.withWatermark(time, late).groupBy(F.window(time, size), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def running_popularity(events: DataFrame) -> DataFrame:
    """Positive counts by item, updated as events come."""
    return label_stream(events).where(F.col("label") == "positive_v1").groupBy("item_id").agg(F.count("*").alias("n"))
