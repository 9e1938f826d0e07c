"""Exact robust scaling and ridge regression from distributed sums."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import exact_quantiles


def scaler_statistics(d: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, feature, center, scale): exact median and interquartile range (1 where it is 0)."""
    long = d.unpivot([F.col(k) for k in keys], [F.col(f) for f in features], "feature", "value").filter(F.col("value").isNotNull())
    return scaler_statistics_long(long, keys)


def sequence_scaler(windows: DataFrame, keys: list[str], features: list[str], window: str = "win") -> DataFrame:
    """(keys, feature, center, scale) over all steps of all windows: ``window`` is an array of steps, each an array of the features."""
    step = F.explode(window)
    long = windows.select(*keys, step.alias("_step")).select(*keys, F.posexplode("_step").alias("_i", "value"))
    names = F.array(*(F.lit(f) for f in features))
    return scaler_statistics_long(long.select(*keys, names[F.col("_i")].alias("feature"), "value"), keys)


def scaler_statistics_long(long: DataFrame, keys: list[str]) -> DataFrame:
    s = exact_quantiles(long.filter(F.col("value").isNotNull()), [*keys, "feature"], "value", {"lower": 0.25, "center": 0.5, "upper": 0.75})
    width = F.col("upper") - F.col("lower")
    return s.select(*keys, "feature", "center", F.when(width > 0, width).otherwise(1.0).alias("scale"))


def sequence_scaled(windows: DataFrame, statistics: DataFrame, keys: list[str], features: list[str], window: str = "win") -> DataFrame:
    """``windows`` scaled by the statistics of their keys (one row a key and feature)."""
    wide = statistics.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("center", "scale")))).alias("_s"))
    of = [F.lit(f) for f in features]
    scaled = F.transform(window, lambda step: F.array(*((F.get(step, F.lit(i)) - F.col("_s")[f]["center"]) / F.col("_s")[f]["scale"] for i, f in enumerate(of))))
    return windows.join(wide, list(keys)).withColumn(window, scaled).drop("_s")


@dataclass
class Ridge:
    """Scaling of features and target, weights on the scaled features."""

    features: list[str]
    center: np.ndarray
    scale: np.ndarray
    y_mean: float
    y_std: float
    weights: np.ndarray
    intercept: float

    def predicted(self, d: DataFrame, name: str = "p") -> DataFrame:
        x = sum(((F.col(f) - float(c)) * float(w / s) for f, c, s, w in zip(self.features, self.center, self.scale, self.weights)), F.lit(float(self.intercept)))
        return d.withColumn(name, x * float(self.y_std) + float(self.y_mean))


def fit_ridge(train: DataFrame, features: list[str], target: str = "y", alpha: float = 1.0) -> Ridge:
    """Robust-scaled features, standardised target, normal equations.

    One pass for the quantiles and one for the sums X'X and X'y; only these (features squared)
    reach the driver. Rows with a missing value are left out; without any row every prediction is 0.
    """
    d = train.select(*(F.col(f).cast("double") for f in features), F.col(target).cast("double").alias("_y")).dropna()
    stats = {r["feature"]: r for r in scaler_statistics(d.withColumn("_k", F.lit(0)), ["_k"], features).collect()}
    if not stats:
        zeros = np.zeros(len(features))
        return Ridge(features, zeros, zeros + 1, 0.0, 1.0, zeros, 0.0)
    center, scale = np.array([stats[f]["center"] for f in features]), np.array([stats[f]["scale"] for f in features])
    row = d.agg(F.avg("_y").alias("m"), F.stddev_pop("_y").alias("s")).first()
    mean, std = row["m"], row["s"] or 1.0
    k = len(features)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xx, xy, x1, n, y1 = np.zeros((k, k)), np.zeros(k), np.zeros(k), 0, 0.0
        for b in batches:
            m = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
            x, y = (m[:, :k] - center) / scale, (m[:, k] - mean) / std
            xx += x.T @ x
            xy += x.T @ y
            x1 += x.sum(axis=0)
            y1 += y.sum()
            n += len(m)
        yield pa.RecordBatch.from_pydict({"i": np.arange(k * k + 2 * k + 2, dtype=np.int32), "v": np.concatenate([xx.ravel(), xy, x1, [float(n), y1]])})

    total = {r["i"]: r["v"] for r in d.mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    v = np.array([total[i] for i in range(k * k + 2 * k + 2)])
    xx, xy, x1, n, y1 = v[: k * k].reshape(k, k), v[k * k : k * k + k], v[k * k + k : k * k + 2 * k], v[-2], v[-1]
    covariance, moment = xx - np.outer(x1, x1) / n, xy - x1 * y1 / n
    weights = np.linalg.solve(covariance + alpha * np.eye(k), moment)
    return Ridge(features, center, scale, mean, std, weights, float(y1 / n - weights @ x1 / n))
