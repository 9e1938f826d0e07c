"""Feature quality control, redundancy and stability screening over a long table (keys..., feature, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import safe_corr
from tidemark.operators.ranks import average_ranks, exact_quantiles


def long_table(wide: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keys, feature, value), missing values kept."""
    return wide.unpivot([F.col(k) for k in keys], [F.col(f) for f in features], "feature", "value")


TAILS = {"q001": 0.001, "q01": 0.01, "median": 0.5, "q99": 0.99, "q999": 0.999}


def numeric_profile(long: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Counts, moments, exact quantiles, the dominant value's share, and the flags that follow."""
    x = F.col("value")
    top = long.filter(x.isNotNull()).groupBy(*keys, "value").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("dominant"), F.count("*").alias("unique_values"))
    d = long.groupBy(*keys).agg(F.count("*").alias("row_count"), F.count(x).alias("present"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min_value"), F.max(x).alias("max_value"), F.avg((x == 0).cast("double")).alias("zero_ratio"))
    d = d.join(exact_quantiles(long, keys, "value", TAILS), list(keys), "left").join(top, list(keys), "left")
    share = F.try_divide("dominant", "present")
    spread = F.greatest(F.abs("q01"), F.abs("q99"))
    d = d.withColumns({"missing": F.col("row_count") - F.col("present"), "dominant_ratio": share})
    return d.withColumns(
        {
            "constant": F.col("unique_values") <= 1,
            "near_constant": F.col("dominant_ratio") >= 0.99,
            "sparse": (F.col("unique_values") <= 2) | (F.col("zero_ratio") >= 0.95),
            "extreme_tail": F.coalesce(F.greatest(F.abs("min_value"), F.abs("max_value")) > 100 * spread, F.lit(False)) & (spread > 0),
        }
    ).drop("dominant")


def block_correlations(long: DataFrame) -> DataFrame:
    """(feature, block, samples, pearson, spearman) of value with y; block NULL is all blocks together."""
    d = long.filter(F.col("value").isNotNull() & F.col("y").isNotNull()).select("feature", "block", "value", "y")
    both = d.withColumn("block", F.explode(F.array(F.col("block"), F.lit(None).cast("int"))))
    keys = ("feature", "block")
    ranked = average_ranks(average_ranks(both, keys, "value", "rx"), keys, "y", "ry")
    return ranked.groupBy(*keys).agg(F.count("*").alias("samples"), safe_corr(F.col("value"), F.col("y")).alias("pearson"), safe_corr(F.col("rx"), F.col("ry")).alias("spearman"))


def classified(correlations: DataFrame, least_same: int = 5, least: float = 0.02) -> DataFrame:
    """Each feature's signs and summaries over blocks; STABLE where at least ``least_same`` blocks share one sign, all rows
    together have it too, and the median over blocks and the whole are strong enough; else WEAK.

    Blocks whose correlation is undefined have no sign and no part in the summaries.
    """
    x, size = F.col("spearman"), F.abs("spearman")
    whole = correlations.filter("block is null").select("feature", F.col("samples").alias("samples"), F.col("spearman").alias("full_spearman"))
    q = lambda c: F.percentile(c, F.lit(0.5))  # noqa: E731 (a value a block)
    per = correlations.filter("block is not null").groupBy("feature").agg(F.count_if(x > 0).alias("positive_blocks"), F.count_if(x < 0).alias("negative_blocks"), q(x).alias("median_spearman"), q(size).alias("median_abs_spearman"), F.min(size).alias("min_abs_spearman"), F.max(size).alias("max_abs_spearman"), F.stddev_pop(x).alias("spearman_std"))
    d = whole.join(per, "feature")
    up, down, full = F.col("positive_blocks"), F.col("negative_blocks"), F.col("full_spearman")
    d = d.withColumns({"dominant_sign": F.when(up > down, "POSITIVE").when(down > up, "NEGATIVE").otherwise("NONE"), "same_sign_blocks": F.greatest(up, down)})
    matches = F.when(up > down, full > 0).when(down > up, full < 0).otherwise(False)
    stable = (F.col("same_sign_blocks") >= least_same) & matches & (F.col("median_abs_spearman") >= least) & (F.abs(full) >= least)
    return d.withColumn("category", F.when(F.coalesce(stable, F.lit(False)), "STABLE").otherwise("WEAK"))


def with_missing(classes: DataFrame, long: DataFrame) -> DataFrame:
    """``classes`` with missing_ratio: the share of rows of ``long`` in which a feature has no value."""
    return classes.join(long.groupBy("feature").agg((1 - F.count("value") / F.count("*")).alias("missing_ratio")), "feature")


def representatives(classes: DataFrame, pairs: DataFrame, least: float = 0.98, strict: bool = False) -> DataFrame:
    """``classes`` (with missing_ratio) with category ALTERNATE and preferred for the weaker feature of each redundant pair (|rho| >= ``least``).

    Preferred: a stable one, then the stronger median, the stronger whole, fewer missing values,
    and the earlier name. An alternate of several preferred ones keeps the best; ``conflicts`` counts
    them, and with ``strict`` more than one raises.
    """
    key = F.struct((F.col("category") == "STABLE").cast("int").alias("s"), F.coalesce("median_abs_spearman", F.lit(-1.0)).alias("m"), F.coalesce(F.abs("full_spearman"), F.lit(-1.0)).alias("f"), (-F.col("missing_ratio")).alias("n"))
    side = lambda p: classes.select(F.col("feature").alias(f"{p}_feature"), key.alias(f"{p}_key"))
    d = pairs.filter(F.abs("rho") >= least).select(F.least("left_feature", "right_feature").alias("left_feature"), F.greatest("left_feature", "right_feature").alias("right_feature"))
    d = d.join(side("left"), "left_feature").join(side("right"), "right_feature")
    right_wins = F.col("right_key") > F.col("left_key")  # left stands earlier
    d = d.select(*(F.when(right_wins, F.col(f"{a}_{c}")).otherwise(F.col(f"{b}_{c}")).alias(f"{role}_{c}") for role, a, b in (("alternate", "left", "right"), ("preferred", "right", "left")) for c in ("feature", "key")))
    chosen = d.groupBy(F.col("alternate_feature").alias("feature"), "preferred_key").agg(F.min("preferred_feature").alias("preferred"), F.collect_set("preferred_feature").alias("all"))
    chosen = chosen.groupBy("feature").agg(F.max_by("preferred", "preferred_key").alias("preferred"), F.sum(F.size("all")).alias("conflicts"))
    if strict:
        chosen = chosen.filter(F.when(F.col("conflicts") > 1, F.raise_error(F.lit("conflicting representatives"))).otherwise(True))
    out = classes.join(chosen, "feature", "left")
    return out.withColumns({"category": F.when(F.col("preferred").isNotNull(), "ALTERNATE").otherwise(F.col("category")), "conflicts": F.coalesce("conflicts", F.lit(0))})


def sparse_events(long: DataFrame) -> DataFrame:
    """Non-zero rows per block; TEMPORALLY_SPARSE where a block has none."""
    per = long.groupBy("feature", "block").agg(F.count_if(F.coalesce(F.col("value") != 0, F.lit(False))).alias("events"))
    return per.groupBy("feature").agg(F.sum("events").alias("events"), F.min("events").alias("least_block_events"), F.when(F.min("events") == 0, "TEMPORALLY_SPARSE").otherwise("COVERED").alias("status"))


def affine_equivalent(d: DataFrame, keys: Sequence[str], x: str, y: str, tolerance: float = 1e-10) -> DataFrame:
    """Whether y = slope x + intercept on all rows up to ``tolerance`` of y's scale."""
    part = Window.partitionBy(*keys)
    slope, intercept = F.regr_slope(F.col(y), F.col(x)).over(part), F.regr_intercept(F.col(y), F.col(x)).over(part)
    e = F.abs(F.col(y) - (slope * F.col(x) + intercept))
    d = d.withColumns({"_e": e, "_s": F.abs(F.col(y))})
    return d.groupBy(*keys).agg(F.max("_e").alias("largest_residual"), (F.max("_e") <= tolerance * F.greatest(F.max("_s"), F.lit(1.0))).alias("equivalent"))
