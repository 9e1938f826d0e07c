"""Chunks of time: the same rows whatever the length of a chunk, and states against plain walks."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import recurrent_features as rf
from tidemark.operators.chunks import segment_numbers
from tidemark.operators.f0 import eligible, f0_features
from tidemark.operators.windowed_features import windowed_features

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, open_time timestamp_ntz, open double, high double, low double, close double, volume double"


def walk(n=900, seed=0, gaps=(5, 300, 301, 302, 310, 500, 700)):
    rng = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    o = c * np.exp(rng.normal(0, 0.004, n))
    d = pd.DataFrame({"symbol": f"X{seed}", "open_time": [T0 + dt.timedelta(hours=int(i)) for i in range(n)], "open": o, "high": np.maximum(o, c) * 1.003, "low": np.minimum(o, c) * 0.997, "close": c, "volume": rng.integers(1, 50, n).astype(float)})
    return d.drop(index=list(gaps)).reset_index(drop=True)


@pytest.fixture(scope="module")
def bars(spark):
    a, b = walk(), walk(400, 1, ()).iloc[::2]
    a.loc[420, "volume"] = a.loc[610, "close"] = np.nan  # missing inputs inside a segment
    return spark.createDataFrame(pd.concat([a, b]), SCHEMA).replace(float("nan"), None).cache()


def ordered(d):
    return d.toPandas().sort_values(["symbol", "open_time"]).reset_index(drop=True)


def same(a, b):
    assert len(a) == len(b)
    for k in a.columns:
        if pd.api.types.is_float_dtype(a[k]) or str(a[k].dtype) == "Float64":
            np.testing.assert_allclose(a[k].to_numpy(float, na_value=np.nan), b[k].to_numpy(float, na_value=np.nan), rtol=1e-9, atol=1e-10, err_msg=k)
        else:
            assert a[k].astype(str).equals(b[k].astype(str)), k


@pytest.mark.parametrize("work", [rf.recurrent_features, windowed_features, f0_features, lambda b, length=4096: rf.label_atr(b, length=length), lambda b, length=4096: eligible(f0_features(b, length), length)], ids=["recurrent", "windowed", "f0", "label_atr", "eligible"])
def test_rows_do_not_depend_on_the_chunks(bars, work):
    whole = ordered(work(bars))
    for length in (170, 37):
        same(ordered(work(bars, length=length)), whole)


def test_one_long_symbol_on_many_tasks(spark):
    """One gap-free symbol: 250 chunks over 200 partitions, none of which holds more than its chunks and halos."""
    d = spark.createDataFrame(walk(1000, 2, ()), SCHEMA)
    chunks = rf.chunk_rows(d, rf.HALO, 4)
    assert chunks.count() == 250 + -(-rf.HALO // 4) and chunks.selectExpr("max(size(rows))").first()[0] <= rf.HALO + 4
    same(ordered(rf.recurrent_features(d, 40)), ordered(rf.recurrent_features(d)))


@pytest.mark.parametrize("length", [1, 7, 64, 5000])
def test_segment_numbers_equal_a_walk(spark, length):
    rng = np.random.default_rng(length)
    rows = [(s, T0 + dt.timedelta(hours=int(h))) for s in "ab" for h in np.flatnonzero(rng.random(300) < 0.9)]
    got = {(r.symbol, r.open_time): (r.segment, r.row) for r in segment_numbers(spark.createDataFrame(rows, "symbol string, open_time timestamp_ntz"), length).collect()}
    last, segment, row = {}, {}, {}
    for s, t in rows:
        goes_on = s in last and t - last[s] == dt.timedelta(hours=1)
        segment[s], row[s] = (segment[s], row[s] + 1) if goes_on else (segment.get(s, -1) + 1, 0)
        last[s] = t
        assert got[s, t] == (segment[s], row[s])


def test_segments_before_1970_and_of_nothing(spark):
    t = [dt.datetime(1969, 12, 31, h) for h in (21, 22, 23)] + [dt.datetime(1970, 1, 1, 0), dt.datetime(1970, 1, 1, 2)]
    d = spark.createDataFrame([("a", x) for x in t], "symbol string, open_time timestamp_ntz")
    assert [(r.segment, r.row) for r in segment_numbers(d, 2).orderBy("open_time").collect()] == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0)]
    assert segment_numbers(d.limit(0), 2).count() == 0


def test_mean_maps_compose():
    rng = np.random.default_rng(4)
    for _ in range(200):
        x = np.where(rng.random(40) < 0.3, np.nan, rng.normal(0, 1, 40))
        cuts = [0, *sorted(rng.integers(0, 41, 3).tolist()), 40]
        state = None
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                state = rf.ewm_after(state, rf.ewm_map(x[a:b], 0.2), 0.2)
        want = pd.Series(x).ewm(alpha=0.2, adjust=False).mean()
        present = np.isfinite(x)
        if present.any():
            last = int(np.flatnonzero(present)[-1])
            assert np.isclose(state.value, want[last]) and state.count == present.sum() and state.gap == 39 - last
        else:
            assert state is None


def test_kept_pivots_equal_a_greedy_walk():
    rng = np.random.default_rng(5)
    for _ in range(300):
        candidates = np.flatnonzero(rng.random(60) < rng.random())
        before = None if rng.random() < 0.3 else int(rng.integers(-6, 1))
        kept, last = [], before
        for i in candidates.tolist():
            if last is None or i - last >= 5:
                kept.append(i)
                last = i
        assert rf.kept_pivots(candidates, before).tolist() == kept


def test_last_two_equal_a_walk():
    rng = np.random.default_rng(6)
    for _ in range(100):
        pivots = np.flatnonzero(rng.random(200) < rng.choice([0.02, 0.1, 0.3]))
        p, q = rf.last_two(pivots, 200, 3, 20)
        for t in range(200):
            near = [int(i) for i in pivots if i <= t - 3][-2:]
            near = [-1] * (2 - len(near)) + near
            assert [int(p[t]), int(q[t])] == [i if i >= t - 20 and i >= 0 else -1 for i in near]


def test_persistence_goes_on_from_a_state():
    flags = np.array([1, 1, -1, 0, 1])
    assert rf.persistence(flags, [1.0, 4.0]).tolist() == [5, 6, -1, 0, 1] and rf.persistence(flags, [-1.0, 4.0]).tolist() == [1, 2, -1, 0, 1]
