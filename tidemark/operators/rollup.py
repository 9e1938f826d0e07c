"""Exact and count-based rollups from five minutes to hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import HOUR, from_micros, micros

SLOT = 300_000_000
PER_HOUR = HOUR // SLOT


def _hour() -> Column:
    us = micros("open_time")
    return us - F.pmod(us, F.lit(HOUR))


def _ohlcv(additive: list[str]) -> list[Column]:
    return [F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"), *(F.sum(c).alias(c) for c in additive)]


def exact_hours(bars: DataFrame, additive: tuple[str, ...] = ("volume",)) -> DataFrame:
    """Hours that have exactly their twelve five-minute slots, each once."""
    grouped = bars.groupBy("symbol", _hour().alias("us"))
    d = grouped.agg(*_ohlcv(list(additive)), F.count("*").alias("n"), F.count_distinct("open_time").alias("slots"), F.count_if(F.pmod(micros("open_time"), F.lit(SLOT)) != 0).alias("off"))
    whole = d.filter((F.col("n") == PER_HOUR) & (F.col("slots") == PER_HOUR) & (F.col("off") == 0))
    return whole.select("symbol", from_micros(F.col("us")).alias("open_time"), "open", "high", "low", "close", *additive)


def counted_hours(bars: DataFrame, least: int = PER_HOUR, complete_only: bool = True, additive: tuple[str, ...] = ("volume",)) -> DataFrame:
    """Hours by the number of their bars alone (duplicates count)."""
    d = bars.groupBy("symbol", _hour().alias("us")).agg(*_ohlcv(list(additive)), F.count("*").alias("source_bar_count"))
    d = d.filter(F.col("source_bar_count") == least) if complete_only else d
    return d.select("symbol", from_micros(F.col("us")).alias("open_time"), "open", "high", "low", "close", *additive, "source_bar_count")


def incomplete_hours(bars: DataFrame) -> DataFrame:
    """Hours between a symbol's first and last with fewer than twelve slots, hours without any included."""
    seen = bars.groupBy("symbol", _hour().alias("us")).agg(F.collect_set(micros("open_time")).alias("slots"))  # at most twelve
    span = seen.groupBy("symbol").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    spine = span.select("symbol", F.explode(F.sequence("a", "b", F.lit(HOUR))).alias("us"))
    d = spine.join(seen, ["symbol", "us"], "left").withColumn("slots", F.coalesce("slots", F.array().cast("array<bigint>")))
    absent = F.array_except(F.sequence("us", F.col("us") + HOUR - SLOT, F.lit(SLOT)), "slots")
    d = d.withColumn("absent", absent).filter(F.size("absent") > 0)
    text = F.array_join(F.transform("absent", lambda x: F.date_format(from_micros(x), "yyyy-MM-dd'T'HH:mm:ss'Z'")), ";")
    return d.select("symbol", from_micros(F.col("us")).alias("hour"), F.size("slots").cast("long").alias("source_candle_count"), F.size("absent").cast("long").alias("missing_candle_count"), text.alias("missing_timestamps"))


def verification(bars: DataFrame, step_us: int) -> DataFrame:
    """Per symbol: rows, first and last time, off-grid rows, duplicates, and missing slots."""
    d = bars.groupBy("symbol").agg(
        F.count("*").alias("row_count"),
        F.min("open_time").alias("first_time"),
        F.max("open_time").alias("last_time"),
        F.count_distinct("open_time").alias("distinct_times"),
        F.count_if(F.pmod(micros("open_time"), F.lit(step_us)) != 0).alias("grid_violations"),
        F.count_if((F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))).alias("order_violations"),
    )
    expected = F.expr(f"(unix_micros(cast(last_time as timestamp)) - unix_micros(cast(first_time as timestamp))) div {step_us} + 1")
    return d.withColumns({"duplicates": F.col("row_count") - F.col("distinct_times"), "expected_rows": expected}).withColumn("missing_rows", F.col("expected_rows") - F.col("distinct_times"))
