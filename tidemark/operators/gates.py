"""Aggregation over seeds and folds, stability gates and the choice of a winner; input (unit, metric, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def aggregated(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """mean, median, standard deviation (of the population), min and max of each metric."""
    x = F.col("value")
    return long.groupBy(*keys, "metric").agg(F.count(x).alias("units"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.stddev_pop(x).alias("std"), F.min(x).alias("min_value"), F.max(x).alias("max_value"))


def gate(long: DataFrame, keys: Sequence[str], conditions: dict[str, float], least_units: int) -> DataFrame:
    """Passed where each metric exceeds its bound in ``least_units`` units and on average."""
    bound = F.lit(None).cast("double")
    for m, b in conditions.items():
        bound = F.when(F.col("metric") == m, F.lit(float(b))).otherwise(bound)
    d = long.withColumn("bound", bound).filter(F.col("bound").isNotNull())
    per = d.groupBy(*keys, "metric").agg(F.count_if(F.col("value") > F.col("bound")).alias("good"), (F.avg("value") > F.first("bound")).alias("mean_good"))
    return per.groupBy(*keys).agg(F.min("good").alias("least_good_units"), F.every("mean_good").alias("means_good"), (F.every("mean_good") & (F.min("good") >= least_units) & (F.count("*") == len(conditions))).alias("passed"))


def paired_deltas(control: DataFrame, candidate: DataFrame, keys: Sequence[str]) -> DataFrame:
    """candidate - control of every metric that both have."""
    a = control.select(*keys, "metric", F.col("value").alias("control"))
    b = candidate.select(*keys, "metric", F.col("value").alias("candidate"))
    return a.join(b, [*keys, "metric"]).withColumn("delta", F.col("candidate") - F.col("control"))


def ranked(d: DataFrame, order: Sequence[str]) -> DataFrame:
    """``d`` with place (1 is best; all of ``order`` descending) and tied (another row has equal values)."""
    over = Window.orderBy(*(F.desc_nulls_last(c) for c in order))  # one row a candidate
    return d.withColumns({"place": F.rank().over(over), "tied": F.count("*").over(Window.partitionBy(*order)) > 1})


def identical_samples(identities: DataFrame) -> DataFrame:
    """Whether all units of a scope were computed on the same rows."""
    return identities.groupBy("scope").agg(F.count("*").alias("units"), (F.count_distinct("identity") == 1).alias("identical"))
