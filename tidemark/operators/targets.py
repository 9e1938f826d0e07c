"""Forward log-return targets that never bridge a gap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import HOUR, from_micros, micros, natural_log
from tidemark.operators.gaps import by_time

HORIZONS = (1, 3, 6, 12)


def row_based(bars: DataFrame, rows: int) -> DataFrame:
    """ln(close[t + rows] / close[t]) and its time by row number alone."""
    if rows <= 0:
        raise ValueError("the horizon must be positive")
    ahead = F.lead("close", rows).over(by_time())
    return bars.select("symbol", "open_time", F.lead("open_time", rows).over(by_time()).alias("target_row_time"), F.ln(F.try_divide(ahead, F.col("close"))).alias("future_log_return"))


def one_hour(bars: DataFrame) -> DataFrame:
    """Rows whose next bar is exactly one hour later: bar, decision and target time, and the return."""
    d = bars.withColumns({"next_us": F.lead(micros("open_time")).over(by_time()), "next_close": F.lead("close").over(by_time())})
    us = micros("open_time")
    return d.filter(F.col("next_us") - us == HOUR).select("symbol", F.col("open_time").alias("bar_open_time"), from_micros(us + HOUR).alias("decision_time"), from_micros(us + 2 * HOUR).alias("target_time"), natural_log(F.col("next_close") / F.col("close")).alias("future_log_return_1h"))


def _endpoint(bars: DataFrame, hours: int) -> DataFrame:
    return bars.select("symbol", from_micros(micros("open_time") - hours * HOUR).alias("open_time"), F.col("close").alias("end_close"))


def horizon_outcomes(bars: DataFrame, horizons: Sequence[int] = HORIZONS, scope_end_us: Column | None = None) -> DataFrame:
    """Every anchor and horizon with its outcome: ok, boundary, missing_endpoint, broken_path or nonfinite.

    ``scope_end_us``: targets at or after it are outside (default: two hours after the symbol's last bar).
    The endpoint is found by an equi-join on the exact time; the path is whole when the row
    ``h`` ahead is that endpoint.
    """
    last = bars.groupBy("symbol").agg((F.max(micros("open_time")) + 2 * HOUR).alias("scope_end"))
    d = bars.select("symbol", "open_time", "close", *(F.lead(micros("open_time"), h).over(by_time()).alias(f"ahead_{h}") for h in horizons))
    d = d.join(F.broadcast(last), "symbol")
    out = None
    for h in horizons:
        us = micros("open_time")
        own = d.join(_endpoint(bars, h), ["symbol", "open_time"], "left")
        end = scope_end_us if scope_end_us is not None else F.col("scope_end")
        outcome = (
            F.when(us + (h + 1) * HOUR >= end, "boundary")
            .when(F.col("end_close").isNull(), "missing_endpoint")
            .when(F.coalesce(F.col(f"ahead_{h}"), F.lit(-1)) != us + h * HOUR, "broken_path")
            .when(~((F.col("close") > 0) & (F.col("end_close") > 0)), "nonfinite")
            .otherwise("ok")
        )
        value = F.ln(F.try_divide("end_close", "close"))
        own = own.select("symbol", F.lit(h).alias("horizon"), "open_time", from_micros(us + HOUR).alias("decision_time"), from_micros(us + (h + 1) * HOUR).alias("target_time"), outcome.alias("outcome"), value.alias("value"))
        own = own.withColumn("value", F.when(F.col("outcome") == "ok", F.col("value")))
        out = own if out is None else out.unionByName(own)
    return out


def horizon_targets(bars: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    return horizon_outcomes(bars, horizons).filter("outcome = 'ok'").drop("outcome")


def horizon_counts(bars: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    return horizon_outcomes(bars, horizons).groupBy("symbol", "horizon", "outcome").agg(F.count("*").alias("anchors"))
