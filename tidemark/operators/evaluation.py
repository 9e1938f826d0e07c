"""Walk-forward evaluation of three-class predictions, fold by fold, against baselines of the fold's own training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import labels as lab
from tidemark.operators import metrics as mt
from tidemark.operators import splits as sp
from tidemark.operators.diagnostics import winner
from tidemark.staging import staged

CLASSES = (-1, 0, 1)
#: What is averaged over folds: metric of ``class_evaluation``.
PRIMARY = ("accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1", "mcc", "log_loss", "brier", "train_majority_accuracy", "train_majority_balanced_accuracy", "train_majority_macro_f1", "always_neutral_accuracy", "always_neutral_macro_f1", "train_prior_log_loss", "train_prior_brier", "neutral_share", "transitions_per_1000", "mcc_above_zero")
KEYS = ("symbol", "fold")


def with_roles(d: DataFrame, purge_hours: int = 1) -> DataFrame:
    """``d`` (symbol, decision_time, actual, ...) once a fold with trains: its pool rows that are not purged, or its evaluated ones."""
    roles = sp.walk_forward(d, purge_hours).filter("role <> 'purged'")
    return roles.select("symbol", "fold", "decision_time", (F.col("role") != "evaluation").alias("trains")).join(d, ["symbol", "decision_time"])


def train_priors(rows: DataFrame) -> DataFrame:
    """(symbol, fold, majority, prior_0..2) of the training rows; of equally frequent classes the lowest."""
    n = rows.filter("trains").groupBy(*KEYS, F.col("actual").alias("c")).agg(F.count("*").cast("double").alias("n"))
    total = F.sum("n")
    share = lambda c: F.coalesce(F.sum(F.when(F.col("c") == c, F.col("n"))), F.lit(0.0)) / total
    return n.groupBy(*KEYS).agg(F.max_by("c", F.struct("n", -F.col("c"))).alias("majority"), *(share(c).alias(f"prior_{i}") for i, c in enumerate(CLASSES)))


def per_class(d: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, class, precision, recall, f1, support) of actual and predicted; 0 for 0 / 0."""
    return mt.class_table(mt.confusion(d, keys, CLASSES), keys).select(*keys, "class", "precision", "recall", "f1", F.col("t").alias("support"))


def class_evaluation(d: DataFrame, purge_hours: int = 1, probabilities: Sequence[str] | None = None) -> DataFrame:
    """(symbol, fold, ...) of the evaluated rows: hard metrics, probability scores, the same for the baselines, and activity.

    ``d`` has symbol, decision_time, actual, predicted, and one column a class for ``probabilities``
    (without: the predicted class has probability 1). Baselines see the fold's training labels
    alone: always the training majority, always neutral, and the training prior.
    """
    rows = staged(with_roles(d, purge_hours), "fold-rows")
    own = staged(rows.filter("not trains").join(train_priors(rows), list(KEYS)), "evaluated-rows")
    hard = mt.classification_metrics(own, KEYS, CLASSES)
    names = ("accuracy", "balanced_accuracy", "macro_f1")
    for prefix, constant in (("train_majority", F.col("majority")), ("always_neutral", F.lit(0))):
        m = mt.classification_metrics(own.withColumn("predicted", constant), KEYS, CLASSES)
        hard = hard.join(m.select(*KEYS, *(F.col(x).alias(f"{prefix}_{x}") for x in names)), list(KEYS))
    given = [F.col(c) for c in probabilities] if probabilities else [(F.col("predicted") == c).cast("double") for c in CLASSES]
    scored = lambda columns: mt.probability_metrics(own.select(*KEYS, "actual", *(c.alias(f"p_{i}") for i, c in enumerate(columns))), KEYS, CLASSES).drop("samples")
    prior = scored([F.col(f"prior_{i}") for i in range(3)]).withColumnsRenamed({"brier": "train_prior_brier", "log_loss": "train_prior_log_loss"})
    shares = own.groupBy(*KEYS).agg(F.first("majority").alias("train_majority_class"), *(F.avg((F.col("predicted") == c).cast("double")).alias(f"{n}_share") for c, n in zip(CLASSES, ("down", "neutral", "up"))))
    activity = lab.temporal_behaviour(own, list(KEYS), "predicted").select(*KEYS, "transitions", "transitions_per_1000")
    for part in (scored(given), prior, shares, activity):
        hard = hard.join(part, list(KEYS))
    return hard.withColumn("mcc_above_zero", (F.col("mcc") > 0).cast("double"))


def aggregated(evaluations: DataFrame, keys: Sequence[str] = ("symbol",), names: Sequence[str] = PRIMARY) -> DataFrame:
    """(keys, metric, mean, median, std, min_value, max_value) of the metrics over a scope's evaluations."""
    long = evaluations.unpivot(list(keys), [F.col(n).cast("double").alias(n) for n in names], "metric", "value")
    x = F.col("value")
    return long.groupBy(*keys, "metric").agg(F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.stddev_pop(x).alias("std"), F.min(x).alias("min_value"), F.max(x).alias("max_value"))


def selected(candidates: DataFrame, passed: str, order: Sequence[str], name: str) -> DataFrame:
    """The best of the candidates that pass, by ``order`` (all descending); none pass: no row. A tie on all of them raises."""
    return winner(candidates.filter(F.col(passed)), order, name)
