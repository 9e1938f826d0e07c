"""The ten baseline features of an hourly bar; they use bars up to and including t."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import HOUR, finite, from_micros, full, micros, natural_log
from tidemark.operators.chunks import LENGTH, in_chunk, with_halo
from tidemark.operators.gaps import segments

F0 = ("log_return_1h", "log_return_3h", "log_return_6h", "candle_log_return", "high_low_range_pct", "close_position_in_range", "rolling_volatility_6h", "rolling_volatility_24h", "log_volume_change_1h", "relative_volume_24h")


#: Rows before a chunk that its windows reach: 24, and the lag within.
HALO = 32


def f0_features(bars: DataFrame, length: int = LENGTH) -> DataFrame:
    """symbol, segment, open_time, decision_time and the features; NULL while a window is not full."""
    w = in_chunk()
    d = with_halo(segments(bars.withColumn("log_close", natural_log(F.col("close"))), length=length), HALO, length)
    log_close, log_volume = F.col("log_close"), F.log1p("volume")
    d = d.withColumns({"log_return_1h": log_close - F.lag(log_close).over(w), "log_return_3h": log_close - F.lag(log_close, 3).over(w), "log_return_6h": log_close - F.lag(log_close, 6).over(w)})
    span = F.col("high") - F.col("low")
    r = F.col("log_return_1h")
    before = w.rowsBetween(-24, -1)
    usual = full(F.avg("volume").over(before), F.col("volume"), before, 24)
    six, day = w.rowsBetween(-5, 0), w.rowsBetween(-23, 0)
    d = d.withColumns(
        {
            "candle_log_return": F.ln(F.try_divide("close", "open")),
            "high_low_range_pct": F.try_divide(span, F.col("close")),
            "close_position_in_range": F.when(span == 0, 0.5).otherwise(F.try_divide(F.col("close") - F.col("low"), span)),
            "rolling_volatility_6h": full(F.stddev_pop(r).over(six), r, six, 6),
            "rolling_volatility_24h": full(F.stddev_pop(r).over(day), r, day, 24),
            "log_volume_change_1h": log_volume - F.lag(log_volume).over(w),
            "relative_volume_24h": F.try_divide(F.col("volume"), F.when(usual != 0, usual)),
        }
    )
    return d.filter("own").select("symbol", "segment", "open_time", from_micros(micros("open_time") + HOUR).alias("decision_time"), *(finite(F.col(c)).alias(c) for c in F0))


def eligible(features: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows with eligible (24 whole rows in the segment up to here, volatility above 0) and the reason if not."""
    w = in_chunk().rowsBetween(-23, 0)
    whole = F.lit(True)
    for c in F0:
        whole = whole & F.col(c).isNotNull()
    rows = F.count("*").over(w)
    complete = F.sum(whole.cast("int")).over(w)
    sigma = F.col("rolling_volatility_24h")
    reason = F.when(rows < 24, "incomplete_window").when(complete < 24, "nonfinite_feature").when(~(sigma > 0), "nonpositive_sigma").otherwise("usable")
    d = with_halo(features, 24, length).withColumn("reason", reason).filter("own").drop("chunk", "own")
    return d.withColumn("eligible", F.col("reason") == "usable")
