"""Diagnostics of predictions, features, labels and calibrations, as aggregations; and the checks that raise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import safe_corr
from tidemark.operators.metrics import average_rank, directional_accuracy

#: Conditions of the regression gates: metric and the bound it must exceed.
REGRESSION_GATE = {"mae_skill": 0.0, "rmse_skill": 0.0, "r2": 0.0, "ic": 0.0, "rank_ic": 0.0, "directional_accuracy": 0.5}


def required(ok: Column, value: Column, message: str) -> Column:
    """``value`` where ``ok``, else an error that ends the job."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def checked(d: DataFrame, ok: Column, message: str) -> DataFrame:
    """``d`` unchanged; a row that is not ``ok`` raises. A filter, which no plan leaves out whatever columns it reads.

    It may be moved below joins and filters before it, so ``ok`` must hold without their help.
    """
    return d.filter(required(ok, F.lit(True), message))


def finite_values(d: DataFrame, x: str) -> DataFrame:
    """``d`` unchanged; a missing, infinite or NaN value raises."""
    c = F.col(x).cast("double")
    return checked(d, c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), f"{x} is not finite")


def nonempty(d: DataFrame, message: str = "no rows") -> DataFrame:
    """``d`` unchanged; an empty one raises when it is read."""
    counted = checked(d.agg(F.count("*").alias("_n")), F.col("_n") > 0, message).filter("_n < 0")  # never a row
    return d.unionByName(counted.select(*(F.lit(None).cast(kind).alias(c) for c, kind in d.dtypes)))


def label_domain(d: DataFrame, label: str) -> DataFrame:
    """``d`` unchanged; a label other than -1, 0 or 1 raises."""
    return checked(d, F.col(label).isin(-1, 0, 1), f"{label} is not a label")


def must_hit(anchors: DataFrame, values: DataFrame, keys: Sequence[str], value: str, positive: bool = False) -> DataFrame:
    """``anchors`` with ``value`` looked up by ``keys``; an anchor without one raises, with ``positive`` also one of at most 0."""
    found = anchors.join(values.select(*keys, value, F.lit(True).alias("_hit")), list(keys), "left")
    ok = F.col("_hit") & (F.col(value) > 0) if positive else F.col("_hit")
    return checked(found, ok, f"no {'positive ' if positive else ''}{value} for an anchor").drop("_hit")


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which a key that stands twice on a side raises."""
    single = lambda d: d.withColumn(keys[-1], required(F.count("*").over(Window.partitionBy(*keys)) == 1, F.col(keys[-1]), "a key stands twice"))
    return single(left).join(single(right), list(keys))


def prediction_diagnostics(d: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Residual, spreads and ratios of magnitude of (y, p), for rows with both values."""
    y, p = F.col("y"), F.col("p")
    d = d.filter(y.isNotNull() & p.isNotNull())
    return d.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        F.avg(y - p).alias("residual_mean"),
        F.stddev_pop(y - p).alias("residual_std"),
        F.avg(y).alias("target_mean"),
        F.stddev_pop(y).alias("target_std"),
        F.avg(p).alias("prediction_mean"),
        F.stddev_pop(p).alias("prediction_std"),
        F.try_divide(F.stddev_pop(p), F.stddev_pop(y)).alias("std_ratio"),
        F.try_divide(F.avg(F.abs(p)), F.avg(F.abs(y))).alias("mean_abs_ratio"),
        F.avg((p > 0).cast("double")).alias("prediction_positive_ratio"),
        F.avg((y > 0).cast("double")).alias("target_positive_ratio"),
    )


def normalized_metrics(d: DataFrame, keys: Sequence[str]) -> DataFrame:
    """mse, mae, skill against zero and ratio of spreads of (z, zp)."""
    z, p = F.col("z"), F.col("zp")
    d = d.filter(z.isNotNull() & p.isNotNull())
    return d.groupBy(*keys).agg(F.count("*").alias("samples"), F.avg((z - p) * (z - p)).alias("mse"), F.avg(F.abs(z - p)).alias("mae"), (1 - F.try_divide(F.avg((z - p) * (z - p)), F.avg(z * z))).alias("mse_skill"), F.try_divide(F.stddev_pop(p), F.stddev_pop(z)).alias("std_ratio"))


def sigma_selected(d: DataFrame) -> DataFrame:
    """``d`` with usable: sigma is there and positive; a negative sigma raises."""
    return d.withColumn("usable", F.coalesce(required(F.col("sigma").isNull() | (F.col("sigma") >= 0), F.col("sigma") > 0, "a negative sigma"), F.lit(False)))


def normalization_blocks(d: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per block (made before rows without a usable sigma are left out): counts and spreads of y and y / sigma."""
    d = sigma_selected(d)
    own = lambda x: F.when(F.col("usable"), x)
    y, sigma = own(F.col("y")), own(F.col("sigma"))
    z = F.try_divide(y, sigma)
    return d.groupBy(*keys).agg(F.min("decision_time").alias("first_decision"), F.max("decision_time").alias("last_decision"), F.count("*").alias("block_rows"), F.count_if(~F.col("usable")).alias("excluded"), F.count_if("usable").alias("samples"), F.stddev_pop(y).alias("raw_std"), F.avg(sigma).alias("sigma_mean"), F.stddev_pop(z).alias("normalized_std"), F.avg(F.abs(z)).alias("normalized_mean_abs"))


def correlations(d: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson and rank correlation of two columns, for rows with both values."""
    d = d.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = d.withColumns({"_x": average_rank(F.col(x), keys), "_y": average_rank(F.col(y), keys)})
    return d.groupBy(*keys).agg(F.count("*").alias("samples"), safe_corr(F.col(x), F.col(y)).alias("pearson"), safe_corr(F.col("_x"), F.col("_y")).alias("spearman"))


def sign_stability(long: DataFrame, target: str) -> DataFrame:
    """Of each feature: its rank correlation with ``target`` in train and in validation, and whether the signs agree."""
    c = correlations(long, ["feature", "split"], "value", target)
    of = lambda s, m: F.max(F.when(F.col("split") == s, F.col(m)))
    d = c.groupBy("feature").agg(*(of(s, m).alias(f"{s}_{m}") for s in ("train", "validation") for m in ("pearson", "spearman")))
    same = lambda m: F.coalesce((F.signum(f"train_{m}") == F.signum(f"validation_{m}")) & (F.col(f"train_{m}") != 0), F.lit(False))
    return d.withColumns({"pearson_sign_stable": same("pearson"), "spearman_sign_stable": same("spearman")})


def reconciliation(a: DataFrame, b: DataFrame, keys: Sequence[str], relative: float = 1e-12, absolute: float = 1e-15) -> DataFrame:
    """Rows of two tables of one ``value`` a key: only in one, in both and equal up to the tolerance, in both and not."""
    d = a.select(*keys, F.col("value").alias("x")).join(b.select(*keys, F.col("value").alias("y")), list(keys), "full_outer")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    close = F.abs(F.col("x") - F.col("y")) <= absolute + relative * F.abs("y")
    return d.agg(F.count_if(F.col("y").isNull()).alias("only_left"), F.count_if(F.col("x").isNull()).alias("only_right"), F.count_if(both & close).alias("equal"), F.count_if(both & ~close).alias("different"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that stand in one of two sets alone."""
    return a.subtract(b).unionByName(b.subtract(a))


def calibration_rows(samples: DataFrame, block_count: int = 6, horizon_hours: int = 1) -> DataFrame:
    """(symbol, fold, safe, purged): rows of the blocks before each evaluation block that a calibration may see.

    A row whose horizon reaches the first evaluated decision is purged.
    """
    w = Window.partitionBy("symbol")
    d = samples.select("symbol", "decision_time").withColumn("block", F.ntile(block_count).over(w.orderBy("decision_time")))
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(block_count - 2)))).filter(F.col("block") <= F.col("fold") + 2)
    evaluated = F.col("block") == F.col("fold") + 2
    first = F.min(F.when(evaluated, F.col("decision_time"))).over(Window.partitionBy("symbol", "fold"))
    d = d.withColumns({"evaluated": evaluated, "safe": F.col("decision_time") + F.expr(f"interval {horizon_hours} hours") < first})
    return d.filter(~F.col("evaluated")).groupBy("symbol", "fold").agg(F.count_if("safe").alias("safe"), F.count_if(~F.col("safe")).alias("purged"))


def semantic_degradation(agreement: DataFrame, keys: Sequence[str], before: str, after: str, most: float = 0.05) -> DataFrame:
    """Whether the mean over folds of ``after`` lies more than ``most`` below that of ``before``."""
    d = agreement.groupBy(*keys).agg(F.avg(before).alias("mean_before"), F.avg(after).alias("mean_after"))
    return d.withColumns({"percentage_points": 100 * (F.col("mean_after") - F.col("mean_before")), "degraded": F.coalesce(F.col("mean_after") < F.col("mean_before") - most, F.lit(False))})


def sign_agreement(label: Column, y: Column) -> Column:
    """Share of non-neutral labels whose sign is the return's."""
    return F.avg(F.when(label != 0, (F.signum(y) == label).cast("double")))


#: Metrics whose mean over all units or folds must be positive, too.
POSITIVE_MEANS = ("mae_skill", "rmse_skill", "r2")


def rmse_skill() -> Column:
    """1 - rmse / rmse of the zero prediction, from mse_skill."""
    return 1 - F.sqrt(1 - F.col("mse_skill"))


def _means_positive() -> Column:
    return F.coalesce(F.least(*(F.col(f"mean_{m}") for m in POSITIVE_MEANS)) > 0, F.lit(False))


def seed_gate(d: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Each condition of REGRESSION_GATE met by at least ``least`` units, and positive means of the skills and r2.

    ``d`` has a row a unit and a column a metric.
    """
    counts = d.groupBy(*keys).agg(F.count("*").alias("units"), *(F.count_if(F.coalesce(F.col(m) > b, F.lit(False))).alias(f"good_{m}") for m, b in REGRESSION_GATE.items()), *(F.avg(m).alias(f"mean_{m}") for m in POSITIVE_MEANS))
    return counts.withColumn("stable", (F.least(*(F.col(f"good_{m}") for m in REGRESSION_GATE)) >= least) & _means_positive())


def temporal_gate(d: DataFrame, keys: Sequence[str], least: int = 3) -> DataFrame:
    """At least ``least`` folds meet all conditions, and the means over all folds of skills and r2 are positive."""
    good = F.lit(True)
    for m, b in REGRESSION_GATE.items():
        good = good & F.coalesce(F.col(m) > b, F.lit(False))
    d = d.groupBy(*keys).agg(F.count_if(good).alias("positive_folds"), *(F.avg(m).alias(f"mean_{m}") for m in POSITIVE_MEANS))
    return d.withColumn("stable", (F.col("positive_folds") >= least) & _means_positive())


def classification_gate(d: DataFrame, keys: Sequence[str], least: int = 3) -> DataFrame:
    """Folds better than chance (balanced accuracy, MCC) and than the majority's macro F1, and so their means."""
    good = lambda ba, mcc, f1, base: F.coalesce((ba > 1 / 3) & (mcc > 0) & (f1 > base), F.lit(False))
    names = ("balanced_accuracy", "mcc", "macro_f1", "majority_macro_f1")
    d = d.groupBy(*keys).agg(F.count_if(good(*map(F.col, names))).alias("positive_folds"), *(F.avg(m).alias(f"mean_{m}") for m in names))
    return d.withColumn("stable", (F.col("positive_folds") >= least) & good(*(F.col(f"mean_{m}") for m in names)))


def direction_diagnostics(d: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Folds with a direction or rank signal, and the means over folds."""
    bounds = {"directional_accuracy": 0.5, "ic": 0.0, "rank_ic": 0.0}
    return d.groupBy(*keys).agg(*(F.count_if(F.coalesce(F.col(m) > b, F.lit(False))).alias(f"folds_{m}") for m, b in bounds.items()), *(F.avg(m).alias(f"mean_{m}") for m in bounds))


def winner(d: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """The first of ``d`` by ``order`` (all descending); a tie on all of them raises. One row a candidate."""
    w = Window.orderBy(*(F.desc_nulls_last(c) for c in order))
    d = d.withColumns({"_rank": F.rank().over(w), "_tied": F.count("*").over(Window.partitionBy(*order))})
    return d.filter("_rank = 1").withColumn(name, required(F.col("_tied") == 1, F.col(name), "an unresolved tie")).drop("_rank", "_tied")


def longest_gap(gaps: DataFrame, keys: Sequence[str], start: str, length: str) -> DataFrame:
    """The longest gap of each key; of equal ones the earliest."""
    return gaps.groupBy(*keys).agg(F.max_by(start, F.struct(F.col(length), -F.unix_micros(F.col(start).cast("timestamp")))).alias(start), F.max(length).alias(length))


def alignment_sample(anchors: DataFrame) -> DataFrame:
    """Three rows at the start, the middle and the end of each symbol's anchors (none where fewer than nine stand)."""
    w = Window.partitionBy("symbol")
    d = anchors.withColumns({"position": F.row_number().over(w.orderBy("decision_time")) - 1, "n": F.count("*").over(w)})
    middle = F.floor(F.col("n") / 2)
    near = (F.col("position") < 3) | (F.abs(F.col("position") - middle) <= 1) | (F.col("position") >= F.col("n") - 3)
    return d.filter(near & (F.col("n") >= 9)).select("symbol", "decision_time", F.col("position").cast("long").alias("position"))


def best_matches(pairs: DataFrame) -> DataFrame:
    """Of each left feature the best redundant right one: identical first, then the strongest correlation, then by name."""
    w = Window.partitionBy("left_feature").orderBy(F.desc("identical"), F.desc_nulls_last(F.round(F.abs("rho"), 9)), "right_feature")
    return pairs.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def uncovered(categories: DataFrame, expected: DataFrame) -> DataFrame:
    """Features that no category lists or that several do (a cover has none)."""
    n = expected.select("feature").join(categories.groupBy("feature").agg(F.count("*").alias("lists")), "feature", "left")
    return n.withColumn("lists", F.coalesce("lists", F.lit(0))).filter("lists <> 1")


def lowest_loss(d: DataFrame, keys: Sequence[str], step: str, loss: str) -> DataFrame:
    """The step of least loss, the first of equal ones."""
    return d.groupBy(*keys).agg(F.min_by(step, F.struct(loss, step)).alias(step), F.min(loss).alias(loss))


def raw_metrics(d: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Error and direction of predictions brought back to returns: p = zp * sigma."""
    d = d.withColumn("p", F.col("zp") * F.col("sigma")).filter(F.col("p").isNotNull() & F.col("y").isNotNull())
    y, p = F.col("y"), F.col("p")
    return d.groupBy(*keys).agg(F.count("*").alias("samples"), F.avg(F.abs(y - p)).alias("mae"), F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"), safe_corr(y, p).alias("ic"), directional_accuracy(y, p).alias("directional_accuracy"))
