"""Rollups, gaps, targets, splits, labels, metrics and bounds on small hand-made rows."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import labels, linear, metrics, normalization, rollup, splits, targets, validation
from tidemark.operators.gaps import grid_gaps, nearest_grid

T0 = dt.datetime(2024, 1, 1)
BARS = "symbol string, open_time timestamp_ntz, open double, high double, low double, close double, volume double"


def five(spark, slots):
    return spark.createDataFrame([("X", T0 + dt.timedelta(minutes=5 * k), 101.0 + k, 102.0 + k, 100.0 + k, 101.5 + k, 1.0 + k) for k in slots], BARS)


def hours(spark, at, close=None):
    return spark.createDataFrame([("X", T0 + dt.timedelta(hours=h), 1.0, 2.0, 0.5, float((close or {}).get(h, 100 + h)), 1.0) for h in at], BARS)


def test_exact_hour(spark):
    r = rollup.exact_hours(five(spark, range(12))).collect()
    assert [(x.open, x.high, x.low, x.close, x.volume) for x in r] == [(101.0, 113.0, 100.0, 112.5, 78.0)]


def test_incomplete_hour(spark):
    d = five(spark, [k for k in range(24) if k != 5])
    assert [x.open_time for x in rollup.exact_hours(d).collect()] == [T0 + dt.timedelta(hours=1)]
    r = rollup.incomplete_hours(d).first()
    assert (r.source_candle_count, r.missing_candle_count, r.missing_timestamps) == (11, 1, "2024-01-01T00:25:00Z")


def test_duplicate_slot_is_not_a_whole_hour(spark):
    d = five(spark, [*range(11), 10])
    assert rollup.exact_hours(d).count() == 0 and rollup.counted_hours(d).count() == 1


def test_grid_gaps_and_nearest(spark):
    g = grid_gaps(five(spark, [0, 1, 4, 5, 9]), rollup.SLOT).orderBy("gap_start").collect()
    assert [(x.missing, x.duration) for x in g] == [(2, "PT10M"), (3, "PT15M")]
    t = [T0, T0 + dt.timedelta(minutes=6), T0 + dt.timedelta(minutes=12, seconds=30), T0 + dt.timedelta(minutes=19), T0 + dt.timedelta(minutes=21), T0 + dt.timedelta(minutes=5), T0 + dt.timedelta(minutes=30)]
    d = nearest_grid(spark.createDataFrame([("X", x) for x in t], "symbol string, t timestamp_ntz"), rollup.SLOT)
    assert [r.status for r in d.orderBy("t").collect()] == ["COLLIDES_WITH_EXISTING_GRID", "TIE", "AMBIGUOUS_SHARED_TARGET", "AMBIGUOUS_SHARED_TARGET"]


def test_targets(spark):
    r = targets.one_hour(hours(spark, [0, 1], {0: 100, 1: 110})).collect()
    assert len(r) == 1 and math.isclose(r[0].future_log_return_1h, math.log(1.1))
    assert targets.one_hour(hours(spark, [0, 2])).count() == 0 and targets.one_hour(hours(spark, [0])).count() == 0
    with pytest.raises(ValueError):
        targets.row_based(hours(spark, [0, 1]), 0)


def test_horizon_outcomes(spark):
    d = targets.horizon_outcomes(hours(spark, [0, 1, 2, 4, 5, 6, 7, 8]), [3]).orderBy("open_time").collect()
    assert [r.outcome for r in d] == ["missing_endpoint", "broken_path", "broken_path", "ok", "ok", "boundary", "boundary", "boundary"]


def samples(spark, n):
    return spark.createDataFrame([("X", T0 + dt.timedelta(hours=k), T0 + dt.timedelta(hours=k + 1)) for k in range(n)], "symbol string, decision_time timestamp_ntz, target_time timestamp_ntz")


def test_frozen_split_purges(spark):
    s = {(r.split, r.purged): r.n for r in splits.frozen_split(samples(spark, 20)).groupBy("split", "purged").agg(F.count("*").alias("n")).collect()}
    assert s == {("train", False): 13, ("train", True): 1, ("validation", False): 2, ("validation", True): 1, ("test", False): 3}


def test_walk_forward_roles(spark):
    d = splits.walk_forward(samples(spark, 60), 1).filter("fold = 1").groupBy("role").count().collect()
    assert {r["role"]: r["count"] for r in d} == {"evaluation": 10, "purged": 1, "inner_validation": 2, "inner_purged": 1, "inner_train": 16}


def test_hysteresis(spark):
    start = dt.datetime(2024, 1, 1)
    series = {"a": [(h, c) for h, c in enumerate([1, 1, 1, -1, -1, 1, -1, -1, -1])], "b": [(h, 1) for h in (0, 1, 2, 10, 11, 12)]}
    rows = [(s, start + dt.timedelta(hours=h), c) for s, own in series.items() for h, c in own]
    out = labels.hysteresis_labels(spark.createDataFrame(rows, "symbol string, decision_time timestamp_ntz, c int"), "c").orderBy("symbol", "decision_time").collect()
    assert [r.label for r in out] == [0, 0, 1, 1, 1, 1, 1, 1, -1] + [0, 0, 1, 0, 0, 1]


def test_metrics(spark):
    d = spark.createDataFrame([("a", y, y) for y in (0.01, -0.02, 0.03)] + [("b", y, 0.0) for y in (0.01, -0.02, 0.03)], "k string, y double, p double")
    r = {x.k: x for x in metrics.regression_metrics(d, ["k"]).collect()}
    assert r["a"].mae == 0 and r["a"].r2 == 1 and math.isclose(r["a"].rank_ic, 1) and r["a"].directional_accuracy == 1 and r["a"].mse_skill == 1
    assert r["b"].mse_skill == 0 and r["b"].ic is None and r["b"].directional_accuracy == 0


def test_classification(spark):
    rng = np.random.default_rng(0)
    a, p = rng.integers(-1, 2, 300), rng.integers(-1, 2, 300)
    d = spark.createDataFrame([("x", int(i), int(j)) for i, j in zip(a, p)], "k string, actual int, predicted int")
    r = metrics.classification_metrics(d, ["k"]).first()
    t, g = np.array([(a == c).sum() for c in (-1, 0, 1)]), np.array([(p == c).sum() for c in (-1, 0, 1)])
    hit = np.array([((a == c) & (p == c)).sum() for c in (-1, 0, 1)])
    assert math.isclose(r.accuracy, (a == p).mean()) and math.isclose(r.balanced_accuracy, (hit / t).mean())
    mcc = (hit.sum() * 300 - (t * g).sum()) / math.sqrt((300**2 - (g**2).sum()) * (300**2 - (t**2).sum()))
    assert math.isclose(r.mcc, mcc)


def test_normalization_modes(spark):
    rows = [("S", "f", m, x) for m in normalization.MODES for x in (-2.0, 0.0, 1.0, 5.0, None)]
    d = spark.createDataFrame(rows, "symbol string, feature string, mode string, value double")
    f = d.select("mode", "value", normalization.normalized(F.col("value"), F.col("mode"), F.lit(0.0), F.lit(4.0)).alias("z")).collect()
    z = {(r.mode, r.value): r.z for r in f}
    assert z["positive", 5.0] == 1 and z["positive", 1.0] == 0.25 and z["signed", 1.0] == -0.5 and z["binary", 1.0] == 1
    assert z["sparse_signed", -2.0] == -0.5 and z["sparse_positive", 0.0] == 0 and math.isclose(z["sparse_positive", 1.0], math.log(2) / math.log(5))
    assert all(z[m, None] is None for m in normalization.MODES)
    flat = d.filter("value = 5").select("mode", normalization.normalized(F.col("value"), F.col("mode"), F.lit(1.0), F.lit(1.0)).alias("z")).collect()
    assert {r.mode: r.z for r in flat}["positive"] == 0 and {r.mode: r.z for r in flat}["sparse_positive"] == 1


def test_missing_bounds_raise(spark):
    d = spark.createDataFrame([("S", "f", "signed", 1.0)], "symbol string, feature string, mode string, value double")
    empty = normalization.bounds_table(d).filter("false")
    with pytest.raises(Exception, match="no bounds"):
        normalization.apply_bounds(d, empty).collect()


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) * [1, 5, 0.1]
    y = x @ [1.0, -0.2, 3.0] + rng.normal(size=200)
    d = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    model = linear.fit_ridge(d, ["a", "b", "c"])
    q = np.percentile(x, [25, 50, 75], axis=0)
    z, t = (x - q[1]) / (q[2] - q[0]), (y - y.mean()) / y.std()
    zc = z - z.mean(axis=0)
    w = np.linalg.solve(zc.T @ zc + np.eye(3), zc.T @ (t - t.mean()))
    np.testing.assert_allclose(model.weights, w, rtol=1e-9)
    got = np.array([r.p for r in model.predicted(d).select("p").collect()])
    np.testing.assert_allclose(got, ((z - z.mean(axis=0)) @ w) * y.std() + y.mean(), rtol=1e-8)


def test_hourly_assertion(spark):
    validation.assert_hourly(hours(spark, [0, 1], {0: 1.5, 1: 1.5}))
    with pytest.raises(ValueError, match="bad_prices"):
        validation.assert_hourly(hours(spark, [0], {0: -1}))
