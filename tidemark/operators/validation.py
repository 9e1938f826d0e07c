"""Row checks and dataset reports; none of them changes a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import micros
from tidemark.operators.gaps import by_time

PRICES = ("open", "high", "low", "close")


def require_columns(df: DataFrame, required: list[str]) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def ohlcv_report(bars: DataFrame, step_us: int) -> DataFrame:
    """Eight counters per symbol; missing intervals are counted between distinct neighbouring times."""
    missing = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in (*PRICES, "volume")))
    before = F.lag(micros("open_time")).over(by_time())
    d = bars.withColumn("step", micros("open_time") - before)
    return d.groupBy("symbol").agg(
        F.count("*").alias("row_count"),
        F.count_if(missing).alias("missing_values"),
        F.count_if(F.col("step") == 0).alias("duplicate_timestamps"),
        F.count_if(F.col("step") < 0).alias("unordered_timestamps"),
        F.count_if(reduce(lambda a, b: a | b, (F.col(c) <= 0 for c in PRICES))).alias("nonpositive_prices"),
        F.count_if(F.col("high") < F.greatest("open", "close", "low")).alias("high_violations"),
        F.count_if(F.col("low") > F.least("open", "close", "high")).alias("low_violations"),
        F.count_if(F.col("volume") < 0).alias("negative_volume"),
        F.coalesce(F.sum(F.when(F.col("step") > step_us, F.expr(f"step div {step_us} - 1"))), F.lit(0)).cast("long").alias("missing_intervals"),
    )


def assert_hourly(bars: DataFrame) -> None:
    """Raise unless times are unique and hour-aligned and prices finite, positive and ordered."""
    require_columns(bars, ["symbol", "open_time", *PRICES, "volume"])
    bad = reduce(lambda a, b: a | b, (~F.coalesce(F.col(c) > 0, F.lit(False)) | F.isnan(c) for c in PRICES))
    row = bars.agg(
        F.count_if(F.pmod(micros("open_time"), F.lit(3_600_000_000)) != 0).alias("unaligned"),
        (F.count("*") - F.count_distinct("symbol", "open_time")).alias("duplicates"),
        F.count_if(bad).alias("bad_prices"),
        F.count_if(~F.coalesce(F.col("volume") >= 0, F.lit(False))).alias("bad_volume"),
        F.count_if((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))).alias("bad_order"),
    ).first()
    found = {k: n for k, n in row.asDict().items() if n}
    if found:
        raise ValueError(f"invalid hourly bars: {found}")


def row_fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """SHA-256 of the fields as text, joined by the unit separator."""
    return rows.withColumn("digest", F.sha2(F.concat_ws("\u001f", *(F.col(c).cast("string") for c in columns)), 256))


def value_frequency(rows: DataFrame, column: str) -> DataFrame:
    counted = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("frequency"))
    total = rows.agg(F.count("*").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("value", "frequency", (F.col("frequency") / F.col("total")).alias("share"))


# --- raw archive rows -------------------------------------------------------------------------


def expected_unit(period: Column) -> Column:
    """Archives are in milliseconds before 2025-01 and in microseconds from then on."""
    return F.when(period < "2025-01", "ms").otherwise("us")


def detected_unit(value: Column) -> Column:
    return F.when((value >= 10**11) & (value < 10**14), "ms").when((value >= 10**14) & (value < 10**17), "us")


def to_micros(value: Column, unit: Column) -> Column:
    return F.when(unit == "ms", value * 1000).otherwise(value)


def parsed_decimal(text: Column) -> tuple[Column, Column]:
    """(decimal(38,8) or NULL, problem: parse, nan, infinity or NULL)."""
    low = F.lower(F.trim(text))
    value = text.try_cast("decimal(38,8)")
    sign = F.regexp_replace(low, "^[+-]", "")
    problem = F.when(sign == "nan", "nan").when(sign.isin("inf", "infinity"), "infinity").when(value.isNull(), "parse")
    return F.when(problem.isNull(), value), problem


NUMBERS = ("open", "high", "low", "close", "volume", "quote_asset_volume", "taker_buy_base_volume", "taker_buy_quote_volume")


def checked_raw(rows: DataFrame, interval_us: int = 300_000_000) -> DataFrame:
    """Raw string rows (period, archive, line, RAW fields) with typed values and one flag per check."""
    flags: dict[str, Column] = {}
    typed = {}
    for c in NUMBERS:
        value, problem = parsed_decimal(F.col(c))
        typed[f"{c}_value"] = value
        flags[f"{c}_problem"] = problem
    opened, closed = F.col("open_time").try_cast("long"), F.col("close_time").try_cast("long")
    unit = detected_unit(opened)
    d = rows.withColumns(typed | flags | {"unit": unit, "unit_mismatch": F.coalesce(unit != expected_unit(F.col("period")), F.lit(True)), "open_us": to_micros(opened, unit), "close_us": to_micros(closed, unit), "trades": F.col("number_of_trades").try_cast("long")})
    close_end = F.when(F.col("unit") == "ms", F.col("open_us") + interval_us - 1000).otherwise(F.col("open_us") + interval_us - 1)
    by_time = Window.partitionBy("open_us").orderBy("period", "line")
    digest = F.sha2(F.concat_ws("\u001f", *(F.col(c) for c in ("open_time", *NUMBERS, "close_time", "number_of_trades", "ignore"))), 256)
    d = d.withColumns({"digest": digest}).withColumns(
        {
            "off_grid": F.pmod("open_us", F.lit(interval_us)) != 0,
            "close_time_violation": F.col("close_us") != close_end,
            "outside_month": F.date_format(F.timestamp_micros("open_us"), "yyyy-MM") != F.col("period"),
            "nonpositive_price": reduce(lambda a, b: a | b, (F.col(f"{c}_value") <= 0 for c in PRICES)),
            "ohlc_violation": (F.col("high_value") < F.greatest("open_value", "close_value", "low_value")) | (F.col("low_value") > F.least("open_value", "close_value", "high_value")),
            "negative_volume": F.col("volume_value") < 0,
            "zero_volume": F.col("volume_value") == 0,
            "taker_violation": (F.col("taker_buy_base_volume_value") > F.col("volume_value")) | (F.col("taker_buy_quote_volume_value") > F.col("quote_asset_volume_value")),
            "unordered": F.col("open_us") < F.lag("open_us").over(Window.partitionBy("period").orderBy("line")),
            "copy": F.row_number().over(by_time) > 1,
            "conflict": F.col("digest") != F.first("digest").over(by_time),
        }
    )
    return d.withColumns({"duplicate_exact": F.col("copy") & ~F.col("conflict"), "duplicate_conflicting": F.col("copy") & F.col("conflict")})


COUNTED = ("unit_mismatch", "off_grid", "close_time_violation", "outside_month", "nonpositive_price", "ohlc_violation", "negative_volume", "zero_volume", "taker_violation", "unordered", "duplicate_exact", "duplicate_conflicting")


def archive_report(checked: DataFrame) -> DataFrame:
    """Counters and status of every archive; zero volume alone is not invalid."""
    parse = reduce(lambda a, b: a | b, (F.col(f"{c}_problem").isNotNull() for c in NUMBERS)) | F.col("open_us").isNull() | F.col("close_us").isNull() | F.col("trades").isNull()
    d = checked.groupBy("period").agg(F.count("*").alias("row_count"), F.count_if(parse).alias("parse_errors"), *(F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in COUNTED), F.min("open_us").alias("first_us"), F.max("open_us").alias("last_us"))
    broken = reduce(lambda a, b: a + b, (F.col(c) for c in COUNTED if c != "zero_volume"))
    return d.withColumns({"parse_status": F.when(F.col("parse_errors") > 0, "INVALID").otherwise("VALID"), "validation_status": F.when(broken + F.col("parse_errors") > 0, "INVALID").otherwise("VALID")})


def dataset_report(archives: DataFrame) -> DataFrame:
    """One row for all archives: sums, gaps and overlaps between neighbouring months, and a verdict."""
    by_period = Window.orderBy("period")  # one row a month
    d = archives.withColumn("step", F.col("first_us") - F.lag("last_us").over(by_period))
    total = d.agg(
        F.count("*").alias("archives"),
        F.sum("row_count").alias("row_count"),
        F.sum("parse_errors").alias("parse_errors"),
        *(F.sum(c).alias(c) for c in COUNTED),
        F.count_if(F.col("step") > 300_000_000).alias("month_gaps"),
        F.count_if(F.col("step") <= 0).alias("month_overlaps"),
        F.count_if(F.col("validation_status") == "INVALID").alias("invalid_archives"),
    )
    blocked = (F.col("parse_errors") > 0) | (F.col("duplicate_conflicting") > 0) | (F.col("ohlc_violation") > 0) | (F.col("nonpositive_price") > 0)
    return total.withColumn("verdict", F.when(blocked, "BLOCKED").when((F.col("invalid_archives") > 0) | (F.col("month_gaps") > 0), "REVIEW_REQUIRED").otherwise("CLEAN"))
