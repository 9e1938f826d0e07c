"""Features against plain twins, after gaps, and under changes of the future."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import recurrent_features as rf
from tidemark.operators.f0 import F0, f0_features
from tidemark.operators.gaps import segments
from tidemark.operators.windowed_features import WINDOWED, windowed_features

T0 = dt.datetime(2024, 1, 1)


def hourly(n=260, skip=()):
    p = np.arange(n)
    center = 20000 + 7 * p + 180 * np.sin(p / 7)
    o, c = center * (1 + 0.001 * np.sin(p / 3)), center * (1 + 0.001 * np.cos(p / 5))
    h, lo = np.maximum(o, c) * (1.001 + 0.002 * np.sin(p / 4) ** 2), np.minimum(o, c) * (0.999 - 0.002 * np.cos(p / 6) ** 2)
    v = 100 + p % 31 + 10 * np.sin(p / 11) ** 2
    d = pd.DataFrame({"symbol": "X", "open_time": [T0 + dt.timedelta(hours=int(i)) for i in p], "open": o, "high": h, "low": lo, "close": c, "volume": v})
    return d.drop(index=list(skip)).reset_index(drop=True)


def frame(spark, d):
    return spark.createDataFrame(d, "symbol string, open_time timestamp_ntz, open double, high double, low double, close double, volume double")


def run(spark, d):
    a = windowed_features(frame(spark, d)).drop("row").toPandas()
    b = rf.recurrent_features(frame(spark, d)).drop("row").toPandas()
    f = f0_features(frame(spark, d)).drop("decision_time").toPandas()
    m = a.merge(b, on=["symbol", "segment", "open_time"]).merge(f, on=["symbol", "segment", "open_time"])
    return m.sort_values("open_time").reset_index(drop=True)


@pytest.fixture(scope="module")
def whole(spark):
    return run(spark, hourly())


def test_first_valid_rows(whole):
    for name, (first, _) in (WINDOWED | rf.RECURRENT).items():
        present = whole[name].notna().to_numpy()
        assert not present[:first].any(), name
        assert present[first:].all(), name


def test_windowed_twins(whole):
    d = hourly()
    c1 = d.close.shift(1)
    r1 = np.log(c1 / d.close.shift(2))
    mid, dev = c1.rolling(20).mean(), c1.rolling(20).std(ddof=0)
    twins = {
        "band_bb_percB_20_2": (c1 - (mid - 2 * dev)) / (4 * dev),
        "realized_vol_20": r1.rolling(20).std(ddof=0),
        "return_skew_30": r1.rolling(30).skew(),
        "ret_autocorr_1_30": r1.rolling(30).corr(r1.shift(1)),
        "vol_over_median20": d.volume.shift(1) / d.volume.shift(1).rolling(20).median(),
        "roc_10": c1 / c1.shift(10) - 1,
        "volume_percentile_60": d.volume.shift(1).rolling(61).apply(lambda x: (x[:-1] <= x[-1]).mean(), raw=True),
    }
    for name, want in twins.items():
        first = WINDOWED[name][0]
        np.testing.assert_allclose(whole[name].to_numpy(float)[first:], want.to_numpy(float)[first:], rtol=1e-9, atol=1e-10, err_msg=name)


def test_f0_formulas(whole):
    d = hourly()
    row = whole.iloc[30]
    assert math.isclose(row["log_return_3h"], math.log(d.close[30] / d.close[27]), rel_tol=1e-9)
    assert math.isclose(row["relative_volume_24h"], d.volume[30] / d.volume[6:30].mean(), rel_tol=1e-12)
    assert whole["rolling_volatility_24h"].first_valid_index() == 24


def test_future_does_not_change_the_past(spark, whole):
    d = hourly()
    d.loc[200:, ["open", "high", "low", "close", "volume"]] *= 3
    other = run(spark, d)
    for name in (*WINDOWED, *rf.RECURRENT, *F0):
        np.testing.assert_array_equal(whole[name].to_numpy(float)[:200], other[name].to_numpy(float)[:200], err_msg=name)


def test_gap_starts_anew(spark):
    d = hourly(skip=[120])
    got = run(spark, d)
    tail = got[got.segment == 1].reset_index(drop=True)
    alone = run(spark, d.iloc[120:].reset_index(drop=True))
    for name in (*WINDOWED, *rf.RECURRENT, *F0):
        np.testing.assert_allclose(tail[name].to_numpy(float), alone[name].to_numpy(float), rtol=1e-9, atol=1e-10, err_msg=name)


def test_segments(spark):
    s = segments(frame(spark, hourly(30, skip=[10, 11, 20]))).groupBy("segment").count().orderBy("segment").collect()
    assert [(r[0], r[1]) for r in s] == [(0, 10), (1, 8), (2, 9)]


def test_wilder_rsi_restarts_after_a_missing_value():
    x = np.arange(40.0)
    x[20] = np.nan
    out = rf.wilder_rsi(x, 5)
    assert np.isnan(out[:5]).all() and (out[5:20] == 100).all() and np.isnan(out[20:26]).all() and (out[26:] == 100).all()
    assert (rf.wilder_rsi(np.full(10, 3.0), 5)[5:] == 50).all()


def test_wilder_atr():
    c = 100 + np.arange(30.0)
    ranges = rf.bar_ranges(c + 2, c - 1, c)
    atr = rf.wilder_atr(ranges, 14)
    assert np.isnan(atr[:13]).all() and np.allclose(atr[13:], 3.0)


def test_trendline_break():
    high = np.array([1, 2, 3, 10, 3, 2, 1, 2, 3, 8, 3, 2, 2, 2, 9, 9], float)
    close = high - 0.5
    assert rf.trendline_breaks(high, close).tolist() == [0.0] * 15 + [1.0]


def test_trendline_breaks_row_by_row():
    """Against a restatement of the rule, row by row."""
    rng = np.random.default_rng(3)
    hits = 0
    for _ in range(60):
        high = np.round(100 + np.cumsum(rng.normal(0, 1, 120)), 1)
        close = high - np.round(rng.random(120), 1)
        pivots = [p for p in range(3, 119) if high[p] > max(high[p - 3], high[p - 2], high[p - 1], high[p + 1])]
        want = [0.0] * 120
        for s in range(119):
            near = [p for p in pivots if p + 1 <= s and p >= s - 30][-2:]
            if len(near) == 2 and near[1] - near[0] >= 3 and high[near[1]] < high[near[0]]:
                at = lambda k: high[near[0]] + (high[near[1]] - high[near[0]]) / (near[1] - near[0]) * (k - near[0])  # noqa: B023, E731
                want[s + 1] = float(close[s - 1] <= at(s - 1) and close[s] > at(s))
        hits += sum(want)
        assert rf.trendline_breaks(high, close).tolist() == want
    assert hits > 20


def test_persistence():
    assert rf.persistence(np.array([0, 1, 1, -1, -1, -1, 0, 1])).tolist() == [0, 1, 2, -1, -2, -3, 0, 1]
