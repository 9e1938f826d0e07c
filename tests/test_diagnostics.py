"""Checks that raise, gates at their bounds, choices among equals, and the window ridge against numpy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import diagnostics as dg
from tidemark.operators import evaluation, linear, screening


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_checks_raise(spark):
    d = frame(spark, [("a", 1.0), ("b", 2.0)], "k string, v double")
    assert dg.finite_values(d, "v").count() == 2
    for bad in (None, float("nan"), float("inf")):
        with pytest.raises(Exception, match="not finite"):
            dg.finite_values(frame(spark, [("a", bad)], "k string, v double"), "v").collect()
    with pytest.raises(Exception, match="not a label"):
        dg.label_domain(frame(spark, [(2,)], "l int"), "l").collect()
    with pytest.raises(Exception, match="no v for an anchor"):
        dg.must_hit(frame(spark, [("a",), ("c",)], "k string"), d, ["k"], "v").collect()
    assert {r.k: r.v for r in dg.must_hit(d.select("k"), d, ["k"], "v").collect()} == {"a": 1.0, "b": 2.0}
    with pytest.raises(Exception, match="no positive v for an anchor"):
        dg.must_hit(d.select("k"), d.withColumn("v", F.col("v") - 1), ["k"], "v", positive=True).count()
    with pytest.raises(Exception, match="stands twice"):
        dg.one_to_one(d, d.unionByName(d).select("k", F.col("v").alias("w")), ["k"]).collect()
    with pytest.raises(Exception, match="negative sigma"):
        dg.sigma_selected(frame(spark, [(-1.0,)], "sigma double")).collect()


def test_checks_survive_pruning(spark):
    """A plan that reads no column of a checked table still raises."""
    d = frame(spark, [("a", 1.0)], "k string, v double")
    for bad in (None, float("nan"), float("inf")):
        with pytest.raises(Exception, match="not finite"):
            dg.finite_values(frame(spark, [("a", bad)], "k string, v double"), "v").count()
    for bad in (7, None):
        with pytest.raises(Exception, match="not a label"):
            dg.label_domain(frame(spark, [(bad,)], "l int"), "l").count()
    with pytest.raises(Exception, match="no v for an anchor"):
        dg.must_hit(frame(spark, [("a",), ("c",)], "k string"), d, ["k"], "v").count()
    with pytest.raises(Exception, match="no rows"):
        dg.nonempty(d.limit(0)).count()
    assert dg.nonempty(d).collect() == d.collect() and dg.label_domain(frame(spark, [(0,), (1,), (-1,)], "l int"), "l").count() == 3


def test_empty_tables(spark):
    d = frame(spark, [], "symbol string, y double, p double, sigma double, decision_time timestamp_ntz")
    assert dg.prediction_diagnostics(d, ["symbol"]).count() == dg.normalization_blocks(d, ["symbol"]).count() == dg.alignment_sample(d).count() == dg.calibration_rows(d).count() == 0


def test_reconciliation_and_difference(spark):
    a = frame(spark, [(1, 0.5), (2, 0.25), (3, 1.0)], "k int, value double")
    b = frame(spark, [(2, 0.25 * (1 + 5e-13)), (3, 1.1), (4, 0.0)], "k int, value double")
    assert tuple(dg.reconciliation(a, b, ["k"]).first()) == (1, 1, 1, 1)
    assert sorted(r.k for r in dg.symmetric_difference(a.select("k"), b.select("k")).collect()) == [1, 4]


def test_gates_at_their_bounds(spark):
    good = {m: b + 0.1 for m, b in dg.REGRESSION_GATE.items()}
    names = list(good)
    row = lambda s, **c: (s, *[(good | c)[m] for m in names])
    rows = [row("four", **({"ic": 0.0} if i == 0 else {})) for i in range(5)] + [row("three", **({"ic": 0.0} if i < 2 else {})) for i in range(5)]
    d = frame(spark, rows, "symbol string, " + ", ".join(f"{m} double" for m in names))
    assert {r.symbol: r.stable for r in dg.seed_gate(d, ["symbol"], 4).collect()} == {"four": True, "three": False}
    t = {r.symbol: (r.positive_folds, r.stable) for r in dg.temporal_gate(d, ["symbol"]).collect()}
    assert t == {"four": (4, True), "three": (3, True)}
    low = frame(spark, [row("x", r2=-9.0 if i == 0 else 0.1) for i in range(4)], "symbol string, " + ", ".join(f"{m} double" for m in names))
    assert not dg.temporal_gate(low, ["symbol"]).first().stable  # three good folds, a negative mean
    for column in ("r2", "mae_skill", "rmse_skill"):  # four good units of five, the fifth spoils the mean
        d = frame(spark, [row("x", **{column: -9.0 if i == 0 else 0.1}) for i in range(5)], "symbol string, " + ", ".join(f"{m} double" for m in names))
        g = dg.seed_gate(d, ["symbol"], 4).first()
        assert g[f"good_{column}"] == 4 and not g.stable and not dg.temporal_gate(d, ["symbol"]).first().stable
    c = frame(spark, [("a", 1 / 3 + x, 0.1, 0.4, 0.3) for x in (0.1, 0.1, 0.1, 0.0)] + [("b", 0.5, 0.1, 0.3, 0.3)] * 4, "symbol string, balanced_accuracy double, mcc double, macro_f1 double, majority_macro_f1 double")
    assert {r.symbol: (r.positive_folds, r.stable) for r in dg.classification_gate(c, ["symbol"]).collect()} == {"a": (3, True), "b": (0, False)}


def test_winner_and_ties(spark):
    d = frame(spark, [("a", 3, 0.1), ("b", 3, 0.2), ("c", 2, 0.9)], "name string, folds int, skill double")
    assert dg.winner(d, ["folds", "skill"], "name").first().name == "b"
    with pytest.raises(Exception, match="unresolved tie"):
        dg.winner(d.withColumn("skill", F.lit(0.0)), ["folds", "skill"], "name").collect()
    passing = d.withColumn("passed", F.col("name") == "c")
    assert evaluation.selected(passing, "passed", ["folds", "skill"], "name").first().name == "c"
    assert evaluation.selected(passing.withColumn("passed", F.lit(False)), "passed", ["folds", "skill"], "name").count() == 0
    losses = frame(spark, [("a", 1, 0.5), ("a", 2, 0.3), ("a", 3, 0.3)], "s string, epoch int, loss double")
    assert dg.lowest_loss(losses, ["s"], "epoch", "loss").first().epoch == 2


def test_longest_gap_takes_the_earliest(spark):
    t = dt.datetime(2024, 1, 1)
    gaps = frame(spark, [("a", t + dt.timedelta(hours=h), n) for h, n in ((5, 3), (20, 7), (40, 7))], "s string, at timestamp_ntz, missing long")
    assert tuple(dg.longest_gap(gaps, ["s"], "at", "missing").first()) == ("a", t + dt.timedelta(hours=20), 7)


def test_alignment_sample(spark):
    t = dt.datetime(2024, 1, 1)
    for n, want in ((8, []), (9, list(range(9))), (20, [0, 1, 2, 9, 10, 11, 17, 18, 19])):
        d = frame(spark, [("a", t + dt.timedelta(hours=i)) for i in range(n)], "symbol string, decision_time timestamp_ntz")
        assert sorted(r.position for r in dg.alignment_sample(d).collect()) == want


def test_best_match_and_cover(spark):
    pairs = frame(spark, [("a", "b", 0.9, 0), ("a", "c", -0.95, 0), ("a", "d", 0.2, 1), ("b", "c", 0.5, 0), ("b", "d", -0.5, 0)], "left_feature string, right_feature string, rho double, identical int")
    assert {r.left_feature: r.right_feature for r in dg.best_matches(pairs).collect()} == {"a": "d", "b": "c"}
    names = frame(spark, [("a",), ("b",), ("c",)], "feature string")
    assert {r.feature: r.lists for r in dg.uncovered(frame(spark, [("a",), ("b",), ("b",)], "feature string"), names).collect()} == {"b": 2, "c": 0}


def test_affine_equivalence(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=50)
    rows = [("yes", float(a), float(3 * a - 2)) for a in x] + [("no", float(a), float(a * a)) for a in x]
    got = {r.k: r.equivalent for r in screening.affine_equivalent(frame(spark, rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert got == {"yes": True, "no": False}


def test_ridge_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4)) * [1, 5, 0.1, 2]
    y = x @ [0.5, -0.1, 2.0, 0.0] + rng.normal(size=300)
    names = ["a", "b", "c", "d"]
    d = frame(spark, [(*map(float, r), float(t)) for r, t in zip(x, y)], ", ".join(f"{n} double" for n in names) + ", y double")
    got = np.array([r.p for r in linear.fit_ridge(d, names).predicted(d).select("p").collect()])
    q1, center, q3 = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    z, t = (x - center) / (q3 - q1), (y - y.mean()) / y.std()
    zc, tc = z - z.mean(axis=0), t - t.mean()
    w = np.linalg.solve(zc.T @ zc + np.eye(4), zc.T @ tc)
    want = ((z - z.mean(axis=0)) @ w + t.mean()) * y.std() + y.mean()
    assert np.allclose(np.sort(got), np.sort(want), atol=1e-9)


def test_class_evaluation_row_by_row(spark):
    rng = np.random.default_rng(2)
    t = dt.datetime(2024, 1, 1)
    hours = np.sort(rng.choice(300, 240, replace=False))
    actual, predicted = rng.choice([-1, 0, 1], 240, p=[0.5, 0.3, 0.2]), rng.choice([-1, 0, 1], 240)
    rows = [("a", t + dt.timedelta(hours=int(h)), int(a), int(p)) for h, a, p in zip(hours, actual, predicted)]
    got = {r.fold: r for r in evaluation.class_evaluation(frame(spark, rows, "symbol string, decision_time timestamp_ntz, actual int, predicted int")).collect()}
    blocks = np.array_split(np.arange(240), 6)
    assert sorted(got) == [1, 2, 3, 4]
    for fold in got:
        own = blocks[fold + 1]
        pool = [i for b in blocks[: fold + 1] for i in b if hours[i] + 1 < hours[own[0]]]
        share = np.array([np.mean(actual[pool] == c) for c in (-1, 0, 1)])
        top = (-1, 0, 1)[int(np.argmax(share))]
        r, y, p = got[fold], actual[own], predicted[own]
        assert r.train_majority_class == top and np.isclose(r.train_majority_accuracy, np.mean(y == top)) and np.isclose(r.accuracy, np.mean(y == p))
        s = np.mean(y == top)
        assert np.isclose(r.train_majority_macro_f1, 2 * s / (1 + s) / 3)
        assert np.isclose(r.train_prior_log_loss, -np.mean(np.log(share[y + 1])))
        moves = sum(hours[own[i]] - hours[own[i - 1]] == 1 and p[i] != p[i - 1] for i in range(1, len(own)))
        assert r.transitions == moves and np.isclose(r.transitions_per_1000, 1000 * moves / len(own))
