"""Chronological splits with purging, temporal blocks, and walk-forward folds. Input: (symbol, decision_time, target_time, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.expressions import HOUR, micros


def by_decision() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("decision_time")


def frozen_split(samples: DataFrame, train_percent: int = 70, validation_percent: int = 15) -> DataFrame:
    """``samples`` with split and purged.

    Ranks by decision time set the boundaries; a train or validation row whose target reaches
    the next period is purged, never moved. The test period is not purged.
    """
    whole = Window.partitionBy("symbol")
    d = samples.withColumns({"position": F.row_number().over(by_decision()) - 1, "n": F.count("*").over(whole)})
    d = d.withColumns({"n_train": F.expr(f"n * {train_percent} div 100"), "n_validation": F.expr(f"n * {validation_percent} div 100")})
    start = lambda at: F.max(F.when(F.col("position") == at, F.col("decision_time"))).over(whole)
    d = d.withColumns({"validation_start": start(F.col("n_train")), "test_start": start(F.col("n_train") + F.col("n_validation"))})
    split = F.when(F.col("position") < F.col("n_train"), "train").when(F.col("position") < F.col("n_train") + F.col("n_validation"), "validation").otherwise("test")
    reaches = F.when(split == "train", F.col("target_time") >= F.col("validation_start")).when(split == "validation", F.col("target_time") >= F.col("test_start")).otherwise(False)
    return d.withColumns({"split": split, "purged": F.coalesce(reaches, F.lit(False))}).drop("position", "n", "n_train", "n_validation", "validation_start", "test_start")


def split_summary(split: DataFrame) -> DataFrame:
    return split.groupBy("symbol", "split").agg(F.count_if(~F.col("purged")).alias("rows_kept"), F.count_if("purged").alias("rows_purged"), F.min("decision_time").alias("first_decision"), F.max("decision_time").alias("last_decision"), F.max(F.when(~F.col("purged"), F.col("target_time"))).alias("last_kept_target"))


def split_by_target(samples: DataFrame, train_percent: int = 70, validation_percent: int = 15) -> DataFrame:
    """A helper split on target times alone, without purging; a missing target time keeps a missing label."""
    known = Window.partitionBy("symbol", F.col("target_time").isNull()).orderBy("target_time")
    d = samples.withColumns({"rank": F.row_number().over(known), "n": F.count("target_time").over(Window.partitionBy("symbol"))})
    label = F.when(F.col("target_time").isNull(), F.lit(None)).when(F.col("rank") <= F.expr(f"n * {train_percent} div 100"), "train").when(F.col("rank") <= F.expr(f"n * {train_percent} div 100 + n * {validation_percent} div 100"), "validation").otherwise("test")
    return d.withColumn("split", label).drop("rank", "n")


def blocks(samples: DataFrame, count: int = 6) -> DataFrame:
    """``samples`` with block 1..count: contiguous, of equal number, larger ones first."""
    return samples.withColumn("block", F.ntile(count).over(by_decision()))


def walk_forward(samples: DataFrame, purge_hours: int = 1, block_count: int = 6, inner_percent: int = 15) -> DataFrame:
    """(symbol, fold, decision_time, role): expanding folds, each evaluated on the next block.

    A pool row whose horizon (``purge_hours``) reaches the evaluation is ``purged``; the last
    ``inner_percent`` of the pool validate, and a row that reaches them is ``inner_purged``.
    """
    d = blocks(samples.select("symbol", "decision_time"), block_count)
    folds = d.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(block_count - 2)))).filter(F.col("block") <= F.col("fold") + 2)
    fold = Window.partitionBy("symbol", "fold")
    us = micros("decision_time")
    reach = us + purge_hours * HOUR
    first_of = lambda role: F.min(F.when(role, us)).over(fold)
    folds = folds.withColumn("evaluated", F.col("block") == F.col("fold") + 2)
    folds = folds.withColumn("pool", ~F.col("evaluated") & (reach < first_of(F.col("evaluated"))))
    ordered = fold.orderBy("decision_time")
    folds = folds.withColumns({"in_pool": F.sum(F.col("pool").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)), "pool_size": F.sum(F.col("pool").cast("int")).over(fold)})
    inner = F.greatest(F.lit(1), F.expr(f"pool_size * {inner_percent} div 100"))
    folds = folds.withColumn("inner", F.col("pool") & (F.col("in_pool") > F.col("pool_size") - inner))
    folds = folds.withColumn("inner_first", first_of(F.col("inner")))
    role = F.when(F.col("evaluated"), "evaluation").when(~F.col("pool"), "purged").when(F.col("inner"), "inner_validation").when(reach < F.col("inner_first"), "inner_train").otherwise("inner_purged")
    return folds.select("symbol", "fold", "decision_time", role.alias("role"))


def sample_identity(samples: DataFrame, time: str = "decision_time") -> DataFrame:
    """SHA-256 of each symbol's ordered decision times as little-endian microseconds."""
    big = F.lpad(F.hex(micros(time)), 16, "0")
    little = F.concat(*(F.substring(big, k, 2) for k in range(15, 0, -2)))
    listed = F.array_sort(F.collect_list(F.struct(micros(time).alias("us"), little.alias("bytes"))))
    joined = F.array_join(F.transform(listed, lambda x: x["bytes"]), "")
    return samples.groupBy("symbol").agg(F.count("*").alias("samples"), F.sha2(F.unhex(joined), 256).alias("identity"))
