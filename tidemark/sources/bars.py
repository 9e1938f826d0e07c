"""Adapters from irregular events to OHLCV bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expressions import from_micros, micros


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive-valued events: ts, event_id, event_type, value (only these columns are scanned)."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "event_type", "value").filter(F.col("value") > 0)


def bars(source: DataFrame, minutes: int, symbol: Column | str = "ALL") -> DataFrame:
    """symbol, open_time, open, high, low, close, volume of every bucket with an event.

    One partial aggregation and one shuffle on (symbol, bucket); open and close are the values
    at the first and last time, ties by event_id.
    """
    width = minutes * 60_000_000
    us = micros("ts")
    at = F.struct(us, "event_id")
    key = F.lit(symbol) if isinstance(symbol, str) else symbol
    grouped = source.groupBy(key.alias("symbol"), (us - F.pmod(us, F.lit(width))).alias("us"))
    return grouped.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").cast("double").alias("volume")).select(
        "symbol", from_micros(F.col("us")).alias("open_time"), "open", "high", "low", "close", "volume"
    )


def hourly(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    return bars(events(spark, sf_dir), 60, F.col("event_type") if by_type else "ALL")


def five_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(events(spark, sf_dir), 5)
