"""The summary of a raw archive set: about sixty counters and a decision. Nothing is changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.validation import NUMBERS

INTERVAL = 300_000_000
FLAGS = {
    "timestamp_unit_mismatch_count": "unit_mismatch",
    "alignment_violation_count": "off_grid",
    "close_time_violation_count": "close_time_violation",
    "archive_ordering_violation_count": "unordered",
    "nonpositive_price_row_count": "nonpositive_price",
    "ohlc_violation_count": "ohlc_violation",
    "negative_volume_row_count": "negative_volume",
    "zero_volume_row_count": "zero_volume",
    "taker_violation_count": "taker_violation",
    "month_containment_violation_count": "outside_month",
    "exact_duplicate_row_count": "duplicate_exact",
    "conflicting_duplicate_row_count": "duplicate_conflicting",
}
_SOUND = ("timestamp_unit_mismatch_count", "alignment_violation_count", "close_time_violation_count", "archive_ordering_violation_count", "nonpositive_price_row_count", "ohlc_violation_count", "negative_volume_row_count", "taker_violation_count", "month_containment_violation_count", "exact_duplicate_row_count", "conflicting_duplicate_row_count")


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def archive_counters(checked: DataFrame) -> DataFrame:
    """One row an archive of ``checked_raw`` rows: counters, first and last time, parse and validation status."""
    malformed = F.col("open_time").isNull()  # a row of another width
    failed = {k: _any([F.col(f"{c}_problem") == k for c in NUMBERS]) for k in ("parse", "nan", "infinity")}
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    no_time = ~malformed & (F.col("open_us").isNull() | F.col("close_us").isNull())
    d = checked.groupBy("period").agg(
        F.count("*").alias("total_row_count"),
        count(malformed).alias("malformed_row_count"),
        count(no_time).alias("timestamp_parse_failure_count"),
        count(~malformed & failed["parse"]).alias("numeric_parse_failure_count"),
        count(failed["nan"]).alias("nan_count"),
        count(failed["infinity"]).alias("infinity_count"),
        count(~malformed & (_any([F.col(f"{c}_problem").isNotNull() for c in NUMBERS]) | F.col("trades").isNull())).alias("invalid_numeric_row_count"),
        count(F.col("trades") < 0).alias("negative_trade_count_row_count"),
        *(count(~malformed & F.col(c)).alias(n) for n, c in FLAGS.items()),
        F.min("open_us").alias("first_us"),
        F.max("open_us").alias("last_us"),
    )
    parsed = F.col("malformed_row_count") + F.col("timestamp_parse_failure_count") + F.col("invalid_numeric_row_count") == 0
    sound = reduce(lambda a, b: a + b, (F.col(c) for c in (*_SOUND, "negative_trade_count_row_count"))) == 0
    return d.withColumns({"unit": F.when(F.col("period") < "2025-01", "ms").otherwise("us"), "parse_valid": parsed, "valid": parsed & sound & (F.col("total_row_count") > 0)})


def raw_gaps(checked: DataFrame, cutoff_us: int) -> DataFrame:
    """(gap_start_us, missing): runs of missing slots of the grid that starts at the first time, up to the cutoff."""
    times = checked.filter(F.col("open_us").isNotNull()).select(F.col("open_us").alias("us")).distinct()
    first = times.agg(F.min("us").alias("first"))
    on_grid = times.crossJoin(F.broadcast(first)).filter((F.col("us") < cutoff_us) & (F.pmod(F.col("us") - F.col("first"), F.lit(INTERVAL)) == 0)).select("us")
    end = first.filter(F.col("first").isNotNull()).select(F.lit(cutoff_us).cast("long").alias("us"))
    # neighbours within a day, and each day's last with the next day's first: no window holds all times
    day = F.floor(F.col("us") / F.lit(86_400_000_000)).alias("day")
    d = on_grid.unionByName(end).select("us", day)
    inside = Window.partitionBy("day").orderBy("us")
    edges = d.groupBy("day").agg(F.min("us").alias("least"), F.max("us").alias("most"))
    across = edges.select(F.col("least").alias("us"), F.lag("most").over(Window.orderBy("day")).alias("before"))  # a row a day
    steps = d.select("us", F.lag("us").over(inside).alias("before")).unionByName(across).filter(F.col("before").isNotNull())
    # the cutoff is no slot of the grid itself: the steps to it end before it
    return steps.select((F.col("before") + INTERVAL).alias("gap_start_us"), F.expr(f"(us - before + {INTERVAL - 1}) div {INTERVAL} - 1").alias("missing")).filter("missing > 0")


def raw_summary(checked: DataFrame, cutoff_us: int) -> DataFrame:
    """One row: all counters of the archives, of times, gaps and months, and the decision CLEAN, REVIEW_REQUIRED or BLOCKED."""
    archives = archive_counters(checked)
    by_period = Window.orderBy("period")  # a row a month
    a = archives.withColumn("_step", F.col("first_us") - F.lag("last_us").over(by_period))
    summed = [c for c, t in archives.dtypes if c.endswith("_count")]
    total = a.agg(
        F.count("*").alias("archives_scanned"),
        F.count_if("valid").alias("valid_archive_count"),
        F.count_if(~F.col("valid")).alias("invalid_archive_count"),
        F.count_if("parse_valid").alias("parse_valid_archive_count"),
        F.count_if(~F.col("parse_valid")).alias("parse_invalid_archive_count"),
        F.count_if(F.col("unit") == "ms").alias("millisecond_archive_count"),
        F.count_if(F.col("unit") == "us").alias("microsecond_archive_count"),
        F.count_if(F.col("timestamp_unit_mismatch_count") > 0).alias("timestamp_unit_mismatch_archive_count"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in summed),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.count_if(F.col("_step") <= 0).alias("cross_month_overlap_count"),
        F.count_if(F.col("_step") > INTERVAL).alias("cross_month_gap_count"),
        F.coalesce(F.sum(F.when(F.col("_step") > INTERVAL, F.expr(f"_step div {INTERVAL} - 1"))), F.lit(0)).alias("cross_month_gap_missing_candle_count"),
    )
    times = checked.filter(F.col("open_us").isNotNull()).groupBy("open_us").agg(F.count("*").alias("n"), F.count_distinct("period").alias("periods"))
    seen = times.agg(F.count("*").alias("observed_unique_timestamp_count"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_timestamp_count"), F.count_if(F.col("periods") > 1).alias("cross_month_duplicate_timestamp_count"))
    gaps = raw_gaps(checked, cutoff_us).agg(F.count("*").alias("gap_episode_count"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_candle_count"), F.coalesce(F.max("missing"), F.lit(0)).alias("longest_gap_candles"), F.min("gap_start_us").alias("first_gap_us"), F.max("gap_start_us").alias("last_gap_us"), F.max_by("gap_start_us", F.struct("missing", -F.col("gap_start_us"))).alias("longest_gap_us"))
    ignore = checked.filter(F.col("ignore").isNotNull()).groupBy("ignore").agg(F.count("*").alias("n"))
    ignored = ignore.agg(F.count("*").alias("ignore_unique_value_count"), F.coalesce(F.sum(F.when(F.col("ignore") == "0", F.col("n"))), F.lit(0)).alias("ignore_zero_count"), F.coalesce(F.sum(F.when(F.col("ignore") != "0", F.col("n"))), F.lit(0)).alias("ignore_nonzero_count"))
    odd = checked.select(F.coalesce("off_grid", F.lit(False)).alias("off"), F.coalesce("close_time_violation", F.lit(False)).alias("late"), "zero_volume", "ignore")
    anomalies = odd.filter("off or late").agg(F.count("*").alias("timestamp_anomaly_row_count"), F.count_if(F.expr("off and late")).alias("close_time_overlap_off_grid_count"), F.count_if(F.expr("late and not off")).alias("close_time_only_violation_count"), F.count_if("zero_volume").alias("timestamp_anomaly_zero_volume_count"), F.count_if(F.col("ignore") != "0").alias("timestamp_anomaly_nonzero_ignore_count"))
    d = total
    for one in (seen, gaps, ignored, anomalies):  # one row each
        d = d.crossJoin(F.broadcast(one))
    expected = F.when(F.col("first_us") < cutoff_us, F.expr(f"({cutoff_us} - first_us + {INTERVAL - 1}) div {INTERVAL}")).otherwise(0)
    d = d.withColumn("expected_candle_count", F.coalesce(expected, F.lit(0)).cast("long"))
    d = d.withColumns(
        {
            "observed_unique_candle_count": F.col("expected_candle_count") - F.col("missing_candle_count"),
            "missing_percentage": F.when(F.col("expected_candle_count") > 0, 100 * F.col("missing_candle_count") / F.col("expected_candle_count")).otherwise(0.0),
            "longest_gap_duration": F.format_string("PT%dM", F.expr(f"longest_gap_candles * {INTERVAL} div 60000000")),
            "global_ordering_monotonic": (F.col("archive_ordering_violation_count") == 0) & (F.col("cross_month_overlap_count") == 0),
            "execution_status": F.when(F.col("first_us").isNotNull(), "COMPLETE").otherwise("BLOCKED"),
        }
    )
    review = (F.col("invalid_archive_count") > 0) | (F.col("duplicate_timestamp_count") > 0) | (F.col("missing_candle_count") > 0) | ~F.col("global_ordering_monotonic")
    return d.withColumn("dataset_quality_decision", F.when(F.col("execution_status") == "BLOCKED", "BLOCKED").when(review, "REVIEW_REQUIRED").otherwise("CLEAN"))
