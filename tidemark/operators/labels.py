"""Three-class trend labels, volatility regimes, hysteresis and their diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import HOUR, micros

THIRD = 1 / 3


def calibrated(d: DataFrame) -> DataFrame:
    """Per symbol: tau of the fixed labels, k of the adaptive ones, and the regime cuts. Columns y, atr_pct, sigma.

    To be taken on training rows alone; the cuts then hold for all rows.
    """
    ratio = F.abs(F.try_divide("y", "atr_pct"))
    cuts = F.percentile("sigma", F.array(F.lit(0.33), F.lit(0.67)))
    return d.groupBy("symbol").agg(F.percentile(F.abs("y"), F.lit(THIRD)).alias("tau"), F.percentile(ratio, F.lit(THIRD)).alias("k"), cuts[0].alias("low_cut"), cuts[1].alias("high_cut"))


def three_classes(y, threshold):
    """1 above the threshold, -1 below its negative, else 0; strict."""
    return F.when(y > threshold, 1).when(y < -threshold, -1).when(y.isNotNull() & threshold.isNotNull(), 0)


def labelled(d: DataFrame, calibration: DataFrame) -> DataFrame:
    """``d`` with label_fixed, label_adaptive and regime. One calibration row per symbol."""
    d = d.join(calibration, "symbol")
    regime = F.when(F.col("sigma") <= F.col("low_cut"), "LOW").when(F.col("sigma") <= F.col("high_cut"), "MID").when(F.col("sigma").isNotNull(), "HIGH")
    return d.withColumns({"label_fixed": three_classes(F.col("y"), F.col("tau")), "label_adaptive": three_classes(F.col("y"), F.col("k") * F.col("atr_pct")), "regime": regime}).drop("tau", "k", "low_cut", "high_cut")


def hysteresis_labels(d: DataFrame, label: str, confirm: int = 3) -> DataFrame:
    """symbol, decision_time, candidate and the label after hysteresis.

    Within a gap-free stretch the label is the last candidate that stood ``confirm`` times in a
    row, and 0 before the first; a gap starts anew.
    """
    w = Window.partitionBy("symbol").orderBy("decision_time")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.filter(F.col(label).isNotNull()).select("symbol", "decision_time", F.col(label).cast("long").alias("candidate"))
    us = micros("decision_time")
    gap = F.coalesce(us - F.lag(us).over(w) != HOUR, F.lit(True))
    d = d.withColumns({"gap": gap, "starts": gap | F.coalesce(F.col("candidate") != F.lag("candidate").over(w), F.lit(True))})
    d = d.withColumns({"stretch": F.sum(F.col("gap").cast("int")).over(so_far), "run": F.sum(F.col("starts").cast("int")).over(so_far)})
    d = d.withColumn("standing", F.row_number().over(Window.partitionBy("symbol", "run").orderBy("decision_time")))
    confirmed = F.when(F.col("standing") >= confirm, F.col("candidate"))
    state = F.last(confirmed, ignorenulls=True).over(Window.partitionBy("symbol", "stretch").orderBy("decision_time").rowsBetween(Window.unboundedPreceding, 0))
    return d.select("symbol", "decision_time", "candidate", F.coalesce(state, F.lit(0)).cast("long").alias("label"))


def class_structure(d: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Counts, shares, majority share and normalised entropy of the three classes."""
    n = F.count(label)
    share = lambda c: F.try_divide(F.count_if(F.col(label) == c), n)
    d = d.groupBy(*keys).agg(n.alias("samples"), share(-1).alias("down_share"), share(0).alias("neutral_share"), share(1).alias("up_share"))
    part = lambda c: F.when(F.col(c) > 0, -F.col(c) * F.ln(F.col(c))).otherwise(0.0)
    shares = ("down_share", "neutral_share", "up_share")
    return d.withColumns({"majority_share": F.greatest(*shares), "entropy": sum((part(c) for c in shares), F.lit(0.0)) / F.ln(F.lit(3.0))})


def runs(d: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """(keys, run, label, length): maximal runs of one label without a gap of more than an hour."""
    w = Window.partitionBy(*keys).orderBy("decision_time")
    us = micros("decision_time")
    gap = F.coalesce(us - F.lag(us).over(w) != HOUR, F.lit(True))
    change = F.coalesce(F.col(label) != F.lag(label).over(w), F.lit(True))
    d = d.withColumns({"gap": gap, "starts": gap | change, "transition": ~gap & change})
    d = d.withColumn("run", F.sum(F.col("starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "run").agg(F.first(label).alias("label"), F.count("*").alias("length"), F.max(F.col("transition").cast("int")).alias("transition"))


def temporal_behaviour(d: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Runs, transitions per thousand rows, and mean, median, 90 % and longest duration."""
    r = runs(d, keys, label)
    q = F.percentile("length", F.array(F.lit(0.5), F.lit(0.9)))
    return r.groupBy(*keys).agg(F.count("*").alias("runs"), F.sum("transition").cast("long").alias("transitions"), (1000 * F.sum("transition") / F.sum("length")).alias("transitions_per_1000"), F.avg("length").alias("mean_duration"), q[0].alias("median_duration"), q[1].alias("p90_duration"), F.max("length").alias("max_duration"))


def semantics(d: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Per label: rows, mean, median and positive share of the future return, and agreement of signs."""
    y = F.col("y")
    agree = F.when(F.col(label) != 0, (F.signum(y) == F.col(label)).cast("double"))
    return d.groupBy(*keys, F.col(label).alias("label")).agg(F.count("*").alias("samples"), F.avg(y).alias("mean_return"), F.percentile(y, F.lit(0.5)).alias("median_return"), F.avg((y > 0).cast("double")).alias("positive_share"), F.avg(agree).alias("sign_agreement"))


def signal_activity(d: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Entries into and exits from UP and the share of time in it; a gap starts anew."""
    w = Window.partitionBy(*keys).orderBy("decision_time")
    us = micros("decision_time")
    gap = F.coalesce(us - F.lag(us).over(w) != HOUR, F.lit(True))
    now = F.col(label) == 1
    before = ~gap & F.coalesce(F.lag(label).over(w) == 1, F.lit(False))
    d = d.withColumns({"entry": now & ~before, "exit": ~now & before, "active": now})
    return d.groupBy(*keys).agg(F.count_if("entry").alias("entries"), F.count_if("exit").alias("exits"), F.avg(F.col("active").cast("double")).alias("active_share"))


def feasibility(structures: DataFrame, keys: list[str], rare: float = 0.10, dominant: float = 0.80, folds: int = 2) -> DataFrame:
    """PATHOLOGICAL where, in at least ``folds`` folds, a class is rarer than ``rare`` or commoner than ``dominant``."""
    shares = ("down_share", "neutral_share", "up_share")
    bad = (F.least(*shares) < rare) | (F.greatest(*shares) > dominant)
    n = F.count_if(bad)
    return structures.groupBy(*keys).agg(F.count("*").alias("folds"), n.alias("bad_folds"), F.when(n >= folds, "PATHOLOGICAL").otherwise("FEASIBLE").alias("decision"))
