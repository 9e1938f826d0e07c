"""Bounds per symbol and feature, and the six normalisation modes."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import EPS, clip
from tidemark.operators.ranks import exact_quantiles

MODES = ("positive", "signed", "binary", "ternary", "sparse_positive", "sparse_signed")


def bounds_table(long: DataFrame, low: float = 0.2, high: float = 0.8, sparse_low: float = 0.5, sparse_high: float = 0.95) -> DataFrame:
    """(symbol, feature, mode, abs_min, abs_max) of rows (symbol, feature, mode, value).

    Dense modes: quantiles of the values; sparse_positive: of the non-zero ones; sparse_signed: 0
    and the upper quantile of their magnitude; 0 and 0 where nothing is left.
    """
    keys = ["symbol", "feature", "mode"]
    away = long.filter(F.col("value") != 0)
    dense = exact_quantiles(long, keys, "value", {"a": low, "b": high})
    sparse = exact_quantiles(away, keys, "value", {"sa": sparse_low, "sb": sparse_high})
    size = exact_quantiles(away.withColumn("value", F.abs("value")), keys, "value", {"sm": sparse_high})
    d = long.select(*keys).distinct()
    for part in (dense, sparse, size):
        d = d.join(part, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    lowest = F.when(F.col("mode") == "sparse_positive", zero(F.col("sa"))).when(F.col("mode") == "sparse_signed", 0.0).when(F.col("mode") == "binary", 0.0).when(F.col("mode") == "ternary", -1.0).otherwise(zero(F.col("a")))
    highest = F.when(F.col("mode") == "sparse_positive", zero(F.col("sb"))).when(F.col("mode") == "sparse_signed", zero(F.col("sm"))).when(F.col("mode").isin("binary", "ternary"), 1.0).otherwise(zero(F.col("b")))
    return d.select("symbol", "feature", "mode", lowest.alias("abs_min"), highest.alias("abs_max"))


def normalized(x: Column, mode: Column, a: Column, b: Column) -> Column:
    """A value within its bounds by mode; a missing value stays missing, a width of about 0 gives 0."""
    w = b - a
    flat = w <= EPS
    safe = F.when(~flat, w)
    la, lb = F.log1p(F.greatest(a, F.lit(0.0))), F.log1p(F.greatest(b, F.lit(0.0)))
    sparse = F.when(x == 0, 0.0).when(flat | (lb - la <= EPS), 1.0).otherwise(clip(F.try_divide(F.log1p(F.greatest(x, F.lit(0.0))) - la, lb - la), 0, 1))
    value = (
        F.when(mode.isin("binary", "ternary"), x)
        .when(mode == "positive", F.when(flat, 0.0).otherwise(clip((x - a) / safe, 0, 1)))
        .when(mode == "signed", F.when(flat, 0.0).otherwise(clip(-1 + 2 * (x - a) / safe, -1, 1)))
        .when(mode == "sparse_signed", F.when(b <= EPS, 0.0).otherwise(clip(F.try_divide(x, b), -1, 1)))
        .when(mode == "sparse_positive", sparse)
    )
    return F.when(x.isNotNull(), value)


def apply_bounds(long: DataFrame, bounds: DataFrame) -> DataFrame:
    """``long`` with normalized; every (symbol, feature) must have bounds (a missing one raises)."""
    d = long.join(bounds.select("symbol", "feature", "abs_min", "abs_max"), ["symbol", "feature"], "left")
    missing = F.raise_error(F.concat(F.lit("no bounds for "), F.col("symbol"), F.lit("/"), F.col("feature"))).cast("double")
    value = normalized(F.col("value"), F.col("mode"), F.col("abs_min"), F.col("abs_max"))
    return d.withColumn("normalized", F.when(F.col("abs_min").isNull(), missing).otherwise(value)).drop("abs_min", "abs_max")


def update_bounds_json(bounds: DataFrame, path: str) -> dict:
    """Replace the bounds of the symbols in ``bounds`` in a JSON file (bounded: symbols times features)."""
    stored = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
    fresh: dict = {}
    for r in bounds.collect():
        fresh.setdefault(r["symbol"], {})[r["feature"]] = {"abs_min": r["abs_min"], "abs_max": r["abs_max"]}
    stored |= fresh
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump(stored, f, indent=2, sort_keys=True)
    os.replace(path + ".tmp", path)
    return stored
