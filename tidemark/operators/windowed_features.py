"""Causal bar features over bounded windows, as Catalyst expressions.

All use bars before t only (``open_gap_atr_14`` also the open of t). Windows never leave the
gap-free segment; a feature is NULL before its first valid row. Lags are projected once, then
all windows of one frame length share a sort. They partition by chunks of time with a halo of
HALO rows, so a long symbol is spread over tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import EPS, clip, finite, full, safe_corr, true_or_false
from tidemark.operators.chunks import LENGTH, in_chunk, with_halo
from tidemark.operators.gaps import segments

#: Rows before a chunk that its windows reach: 120 + 20 of the volatility percentile, and the lags within.
HALO = 160
#: Feature: (first valid row in the segment, group).
WINDOWED = {
    "amihud_illiquidity_20": (21, "volume"),
    "atr_pct_14": (15, "volatility"),
    "atr_ratio_14_63": (64, "volatility"),
    "band_bb_percB_20_2": (20, "price"),
    "bb_excursion_20_2": (20, "price"),
    "bb_width_rel_20": (20, "price"),
    "bearish_engulf_score": (15, "candle"),
    "body_signed_to_tr": (1, "candle"),
    "body_to_tr": (1, "candle"),
    "breakdown_strength_20": (21, "price"),
    "breakout_strength_20": (21, "price"),
    "bullish_engulf_score": (15, "candle"),
    "cand_up_down_vol_ratio_20": (21, "volume"),
    "channel_pos_20": (20, "price"),
    "close_location_value": (1, "candle"),
    "downside_semivol_20": (21, "volatility"),
    "drawdown_from_peak_60": (60, "price"),
    "efficiency_ratio_20": (21, "price"),
    "inside_bar_compression": (2, "candle"),
    "log_range_over_vol_100": (101, "volatility"),
    "lower_wick_to_tr": (1, "candle"),
    "open_gap_atr_14": (15, "candle"),
    "outside_bar_expansion": (15, "candle"),
    "parkinson_vol_20": (20, "volatility"),
    "range_compression_20_100": (100, "price"),
    "realized_vol_20": (21, "volatility"),
    "ret_autocorr_1_30": (32, "correlation"),
    "ret_vol_corr_30": (31, "correlation"),
    "return_skew_30": (31, "correlation"),
    "roc_10": (11, "price"),
    "sign_flip_rate_20": (22, "correlation"),
    "tr_to_atr_14": (15, "candle"),
    "up_close_ratio_5": (6, "correlation"),
    "upper_wick_to_tr": (1, "candle"),
    "upside_semivol_20": (21, "volatility"),
    "vol_over_median20": (20, "volume"),
    "vol_regime_pct_120": (141, "volatility"),
    "volume_percentile_60": (61, "volume"),
}


def true_range() -> Column:
    """Of the bar itself; the first bar of a segment has high - low."""
    before = F.lag("close").over(in_chunk())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def _last(n: int):
    return in_chunk().rowsBetween(-(n - 1), 0)


def _rolling(aggregate, x: str | Column, n: int) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return full(aggregate(c).over(_last(n)), c, _last(n), n)


def sma_atr(n: int) -> Column:
    """Simple mean of n true ranges; rows before n are NULL. Of the bar itself, not lagged."""
    return F.when(F.col("row") >= n, F.avg("bar_range").over(_last(n)))


def percentile_of_previous(x: str, n: int) -> Column:
    """Share of the n values before that are at most the current one; all must be present."""
    earlier = F.collect_list(x).over(in_chunk().rowsBetween(-n, -1))
    return F.when(F.col(x).isNotNull() & (F.size(earlier) == n), F.size(F.filter(earlier, lambda y: y <= F.col(x))) / F.lit(float(n)))


def with_lags(bars: DataFrame, length: int = LENGTH) -> DataFrame:
    """Segments, chunks with their halo, and the lagged columns that all features share."""
    w = in_chunk()
    d = with_halo(segments(bars, length=length), HALO, length).withColumns({"bar_range": true_range()})
    lag = lambda c, k=1: F.lag(c, k).over(w)
    d = d.withColumns({"c1": lag("close"), "c2": lag("close", 2), "o1": lag("open"), "o2": lag("open", 2), "h1": lag("high"), "h2": lag("high", 2), "l1": lag("low"), "l2": lag("low", 2), "v1": lag("volume"), "range1": lag("bar_range"), "bar_atr14": sma_atr(14), "bar_atr63": sma_atr(63)})
    return d.withColumns({"r1": F.ln(F.try_divide("c1", "c2")), "atr14": lag("bar_atr14"), "atr63": lag("bar_atr63")})


def _degenerate(value: Column, present: Column, flat: Column) -> Column:
    return F.when(present, F.when(flat, 0.0).otherwise(F.coalesce(value, F.lit(0.0))))


def windowed_features(bars: DataFrame, length: int = LENGTH) -> DataFrame:
    """symbol, segment, row, open_time and the features of WINDOWED."""
    w = in_chunk()
    eps = F.lit(EPS)
    d = with_lags(bars, length)
    c1, c2, o1, o2, h1, h2, l1, l2, v1, tr, r1, atr = (F.col(x) for x in ("c1", "c2", "o1", "o2", "h1", "h2", "l1", "l2", "v1", "range1", "r1", "atr14"))
    logc = F.ln(F.col("close") + eps)
    d = d.withColumns(
        {
            "mid20": _rolling(F.avg, "c1", 20),
            "dev20": _rolling(F.stddev_pop, "c1", 20),
            "notional": c1 * v1,
            "step": F.abs(c1 - c2),
            "r2": F.lag("r1").over(w),
            "loghl": F.ln((F.col("high") + eps) / (F.col("low") + eps)),
            "lc": F.lag(logc).over(w),
            "lr": F.lag(logc).over(w) - F.lag(logc, 2).over(w),
            "max20": _rolling(F.max, "h1", 20),
            "min20": _rolling(F.min, "l1", 20),
        }
    )
    d = d.withColumn("loghl1", F.lag("loghl").over(w)).withColumn("rv20", _rolling(F.stddev_samp, "lr", 20))
    body, span, mother = F.abs(c1 - o1), h1 - l1, h2 - l2
    width = 4 * F.col("dev20")
    percent_b = F.when(F.abs(width) > EPS, (c1 - (F.col("mid20") - 2 * F.col("dev20"))) / width).when(width.isNotNull(), 0.5)
    d = d.withColumns({"pb": percent_b, "flip": true_or_false(F.signum("r1") * F.signum("r2") < 0).cast("double"), "up": true_or_false(c1 > c2).cast("double")})
    bearish = true_or_false((c2 > o2) & (c1 < o1) & (o1 >= c2) & (c1 <= o2))
    bullish = true_or_false((c2 < o2) & (c1 > o1) & (o1 <= c2) & (c1 >= o2))
    before20 = lambda f, x: full(f(F.col(x)).over(w.rowsBetween(-21, -2)), F.col(x), w.rowsBetween(-21, -2), 20)
    pb = F.col("pb")
    inside = true_or_false((h1 <= h2) & (l1 >= l2)) & F.coalesce(mother > EPS, F.lit(False))
    outside = true_or_false((h1 >= h2) & (l1 <= l2)).cast("double")
    s30 = _rolling(F.stddev_pop, "r1", 30)
    n30 = F.count("r1").over(_last(30)) == 30
    skew = F.skewness("r1").over(_last(30)) * (math.sqrt(30 * 29) / 28)
    features = {
        "amihud_illiquidity_20": _rolling(F.avg, F.abs(r1) / F.when(F.col("notional") > EPS, F.col("notional")), 20),
        "atr_pct_14": atr / (c1 + eps),
        "atr_ratio_14_63": atr / (F.col("atr63") + eps),
        "band_bb_percB_20_2": pb,
        "bb_excursion_20_2": F.when(pb.isNotNull(), F.least(pb, F.lit(0.0)) + F.greatest(pb - 1, F.lit(0.0))),
        "bb_width_rel_20": width / F.when(F.abs("mid20") > EPS, F.col("mid20")),
        "bearish_engulf_score": bearish.cast("double") * body / (atr + eps),
        "body_signed_to_tr": clip((c1 - o1) / (tr + eps), -1, 1),
        "body_to_tr": body / (tr + eps),
        "breakdown_strength_20": clip(before20(F.min, "low") - c1, low=0) / (atr + eps),
        "breakout_strength_20": clip(c1 - before20(F.max, "high"), low=0) / (atr + eps),
        "bullish_engulf_score": bullish.cast("double") * body / (atr + eps),
        "cand_up_down_vol_ratio_20": F.sum(F.when(c1 > c2, v1).otherwise(0.0)).over(_last(20)) / (F.sum(F.when(c1 < c2, v1).otherwise(0.0)).over(_last(20)) + eps),
        "channel_pos_20": clip((c1 - F.col("min20")) / (F.col("max20") - F.col("min20") + eps), 0, 1),
        "close_location_value": F.when(span > EPS, clip(((c1 - l1) - (h1 - c1)) / span, -1, 1)).when(span.isNotNull(), 0.0),
        "downside_semivol_20": F.sqrt(_rolling(F.avg, F.when(r1.isNotNull(), F.pow(F.least(r1, F.lit(0.0)), 2)), 20)),
        "drawdown_from_peak_60": clip((_rolling(F.max, "c1", 60) - c1) / (_rolling(F.max, "c1", 60) + eps), low=0),
        "efficiency_ratio_20": clip(F.abs(c1 - F.lag("c1", 20).over(w)) / (_rolling(F.sum, "step", 20) + eps), 0, 1),
        "inside_bar_compression": F.when(inside, clip(1 - F.try_divide(span, mother), 0, 1)).otherwise(0.0),
        "log_range_over_vol_100": (_rolling(F.max, "lc", 100) - _rolling(F.min, "lc", 100)) / (_rolling(F.stddev_samp, "lr", 100) + eps),
        "lower_wick_to_tr": (F.least(o1, c1) - l1) / (tr + eps),
        "open_gap_atr_14": (F.col("open") - c1) / (atr + eps),
        "outside_bar_expansion": outside * span / (atr + eps),
        "parkinson_vol_20": F.sqrt(_rolling(F.avg, F.pow("loghl1", F.lit(2)), 20) / (4 * math.log(2))),
        "range_compression_20_100": clip((F.col("max20") - F.col("min20")) / (_rolling(F.max, "h1", 100) - _rolling(F.min, "l1", 100) + eps), 0, 1),
        "realized_vol_20": _rolling(F.stddev_pop, "r1", 20),
        "ret_autocorr_1_30": _degenerate(safe_corr(r1, F.col("r2"), _last(30)), n30 & (F.count("r2").over(_last(30)) == 30), (s30 <= EPS) | (_rolling(F.stddev_pop, "r2", 30) <= EPS)),
        "ret_vol_corr_30": _degenerate(safe_corr(F.abs(r1), v1, _last(30)), n30, (_rolling(F.stddev_pop, F.abs(r1), 30) <= EPS) | (_rolling(F.stddev_pop, "v1", 30) <= EPS)),
        "return_skew_30": _degenerate(skew, n30, s30 <= EPS),
        "roc_10": F.try_divide(c1, F.lag("c1", 10).over(w)) - 1,
        "sign_flip_rate_20": _rolling(F.avg, "flip", 20),
        "tr_to_atr_14": tr / (atr + eps),
        "up_close_ratio_5": _rolling(F.avg, "up", 5),
        "upper_wick_to_tr": (h1 - F.greatest(o1, c1)) / (tr + eps),
        "upside_semivol_20": F.sqrt(_rolling(F.avg, F.when(r1.isNotNull(), F.pow(F.greatest(r1, F.lit(0.0)), 2)), 20)),
        "vol_over_median20": v1 / (full(F.percentile("v1", F.lit(0.5)).over(_last(20)), v1, _last(20), 20) + eps),
        "vol_regime_pct_120": percentile_of_previous("rv20", 120),
        "volume_percentile_60": percentile_of_previous("v1", 60),
    }
    d = d.withColumns({f"f_{k}": x for k, x in features.items()})
    return d.filter("own").select("symbol", "segment", "row", "open_time", *(F.when(F.col("row") >= first, finite(F.col(f"f_{k}"))).alias(k) for k, (first, _) in WINDOWED.items()))
