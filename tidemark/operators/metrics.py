"""Regression, correlation and classification metrics as aggregations over (group..., y, p)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import safe_corr
from tidemark.operators.ranks import exact_quantiles


def average_rank(x: Column, keys: Sequence[str]) -> Column:
    """Ranks from 1, ties share their mean; NULL for a missing value."""
    part = Window.partitionBy(*keys, x.isNull())
    tied = Window.partitionBy(*keys, x)
    return F.when(x.isNotNull(), F.rank().over(part.orderBy(x)) + (F.count("*").over(tied) - 1) / 2.0)


def with_ranks(d: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    return d.withColumns({"y_rank": average_rank(F.col(y), keys), "p_rank": average_rank(F.col(p), keys)})


def directional_accuracy(y: Column, p: Column, least: float = 1e-12) -> Column:
    """Among rows whose target is not about 0; a prediction of 0 is a miss."""
    return F.avg(F.when(F.abs(y) > least, (F.signum(y) == F.signum(p)).cast("double")))


def regression_metrics(d: DataFrame, keys: Sequence[str]) -> DataFrame:
    """mae, rmse, r2, ic, rank_ic, directional_accuracy, mse_skill, mae_skill for rows with both values."""
    d = with_ranks(d.filter(F.col("y").isNotNull() & F.col("p").isNotNull()), keys)
    y, p = F.col("y"), F.col("p")
    e = y - p
    spread = F.var_pop(y) * F.count("*")
    r2 = F.when(spread > 0, 1 - F.try_divide(F.sum(e * e), spread)).when(F.sum(e * e) == 0, 1.0).otherwise(0.0)
    return d.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        r2.alias("r2"),
        safe_corr(y, p).alias("ic"),
        safe_corr(F.col("y_rank"), F.col("p_rank")).alias("rank_ic"),
        directional_accuracy(y, p).alias("directional_accuracy"),
        (1 - F.try_divide(F.avg(e * e), F.avg(y * y))).alias("mse_skill"),
        (1 - F.try_divide(F.avg(F.abs(e)), F.avg(F.abs(y)))).alias("mae_skill"),
    )


QUANTILES = {"q01": 0.01, "q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99}


def distribution(d: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Count, moments, seven linear quantiles, shares of signs; quantiles are exact."""
    c = F.col(x)
    d = d.filter(c.isNotNull())
    q = exact_quantiles(d, keys, x, QUANTILES)
    middle = exact_quantiles(d.withColumn("_size", F.abs(c)), keys, "_size", {"median_abs": 0.5})
    d = d.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        F.avg(c).alias("mean"),
        F.stddev_pop(c).alias("std"),
        F.sqrt(F.avg(c * c)).alias("rms"),
        F.min(c).alias("min_value"),
        F.max(c).alias("max_value"),
        F.avg(F.abs(c)).alias("mean_abs"),
        F.avg((c > 0).cast("double")).alias("positive_ratio"),
        F.avg((c == 0).cast("double")).alias("zero_ratio"),
    )
    return d.join(middle, list(keys)).join(q, list(keys))


def confusion(d: DataFrame, keys: Sequence[str], classes: Sequence[int] = (-1, 0, 1)) -> DataFrame:
    """(keys, actual, predicted, n) of all pairs of classes, absent ones with 0."""
    grid = d.select(*keys).distinct().withColumn("actual", F.explode(F.lit(list(classes)))).withColumn("predicted", F.explode(F.lit(list(classes))))
    counted = d.groupBy(*keys, "actual", "predicted").agg(F.count("*").alias("n"))
    return grid.join(counted, [*keys, "actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def class_table(matrix: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, class, t, hit, g, precision, recall, f1): rows of a class, hits and guesses; 0 for 0 / 0."""
    diagonal = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    # both sides of a cell count for their class: one pass over the matrix
    sides = matrix.select(*keys, F.inline(F.array(F.struct(F.col("actual").alias("class"), F.col("n").alias("t"), diagonal.alias("hit"), F.lit(0).cast("long").alias("g")), F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("hit"), F.col("n").alias("g")))))
    c = sides.groupBy(*keys, "class").agg(F.sum("t").alias("t"), F.sum("hit").alias("hit"), F.sum("g").alias("g"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = c.withColumns({"precision": zero(F.col("hit"), F.col("g")), "recall": zero(F.col("hit"), F.col("t"))})
    return c.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def classification_metrics(d: DataFrame, keys: Sequence[str], classes: Sequence[int] = (-1, 0, 1)) -> DataFrame:
    """accuracy, balanced accuracy, macro precision, recall and F1 (0 for 0 / 0), and Matthews' coefficient."""
    c = class_table(confusion(d, keys, classes), keys)
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    n, hit = F.sum("t"), F.sum("hit")
    # in double: squares of counts leave the range of long integers on large tables
    t, g = F.col("t").cast("double"), F.col("g").cast("double")
    top = hit.cast("double") * n - F.sum(t * g)
    below = F.sqrt(n.cast("double") * n - F.sum(g * g)) * F.sqrt(n.cast("double") * n - F.sum(t * t))
    return c.groupBy(*keys).agg(n.alias("samples"), zero(hit, n).alias("accuracy"), F.avg(F.when(F.col("t") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), zero(top, below).alias("mcc"))


def probability_metrics(d: DataFrame, keys: Sequence[str], classes: Sequence[int] = (-1, 0, 1)) -> DataFrame:
    """Multiclass Brier score and log loss of columns p_<i> (in the order of ``classes``) against actual."""
    brier = sum((F.pow(F.col(f"p_{i}") - (F.col("actual") == c).cast("double"), F.lit(2)) for i, c in enumerate(classes)), F.lit(0.0))
    own = F.lit(None).cast("double")
    for i, c in enumerate(classes):
        own = F.when(F.col("actual") == c, F.col(f"p_{i}")).otherwise(own)
    return d.groupBy(*keys).agg(F.count("*").alias("samples"), F.avg(brier).alias("brier"), F.avg(-F.ln(F.greatest(own, F.lit(1e-15)))).alias("log_loss"))
