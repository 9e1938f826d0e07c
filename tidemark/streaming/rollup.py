"""Streaming counterparts: watermarked hourly bars and event sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_bars(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Append-mode hourly bars of a stream (ts, event_id, event_type, value), one row per type once the watermark has passed."""
    d = events.filter(F.col("value") > 0).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    at = F.struct("ts", "event_id")
    w = d.groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("symbol"))
    bars = w.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").cast("double").alias("volume"))
    return bars.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("open_time"), "open", "high", "low", "close", "volume")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Gap-free sessions per type: the streaming form of the segments."""
    d = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    s = d.groupBy(F.session_window("ts", gap).alias("s"), F.col("event_type").alias("symbol")).agg(F.count("*").alias("events"))
    return s.select("symbol", F.col("s.start").alias("first_time"), F.col("s.end").alias("end_time"), "events")
