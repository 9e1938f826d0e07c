"""Report files: complete, in order, replaced as a whole."""

import datetime as dt
import json

import pytest

from tidemark.operators.rollup import incomplete_hours
from tidemark.sources import reports

T0 = dt.datetime(2024, 1, 1)


def test_csv_report_of_incomplete_hours(spark, tmp_path):
    slots = [*range(0, 5), *range(6, 24)]
    bars = spark.createDataFrame([("X", T0 + dt.timedelta(minutes=5 * s), 1.0, 1.0, 1.0, 1.0, 1.0) for s in slots], "symbol string, open_time timestamp_ntz, open double, high double, low double, close double, volume double")
    at = tmp_path / "incomplete.csv"
    for _ in range(2):  # the second replaces the first
        reports.csv_report(incomplete_hours(bars), str(at), ["symbol", "hour"])
    lines = at.read_text().splitlines()
    assert len(lines) == 2 and lines[0].split(",")[:2] == ["symbol", "hour"] and "2024-01-01T00:25:00Z" in lines[1]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["incomplete.csv"]


def test_csv_report_keeps_order_and_missing_values(spark, tmp_path):
    d = spark.createDataFrame([("b", None), ("a", 1.5), ("c", 2.0)], "k string, v double")
    reports.csv_report(d.repartition(3), str(tmp_path / "r.csv"), ["k"])
    assert (tmp_path / "r.csv").read_text().splitlines() == ["k,v", "a,1.5", "b,", "c,2.0"]


def test_json_report(spark, tmp_path):
    d = spark.createDataFrame([(2, 0.5, float("nan"), None)], "b int, a double, n double, m string")
    reports.json_report(d, str(tmp_path / "r.json"))
    text = (tmp_path / "r.json").read_text()
    assert json.loads(text) == {"a": 0.5, "b": 2, "m": None, "n": None} and text.index('"a"') < text.index('"b"')
    with pytest.raises(ValueError, match="one row"):
        reports.json_report(d.limit(0), str(tmp_path / "none.json"))
    assert not (tmp_path / "none.json").exists()


def test_feature_artifact(spark, tmp_path):
    d = spark.createDataFrame([(T0, 1.0, None), (T0 + dt.timedelta(hours=1), None, None)], "open_time timestamp_ntz, x double, y double")
    got = reports.feature_artifact(d, str(tmp_path / "features"), ["x", "y"])
    assert got.count() == 2
    assert json.loads((tmp_path / "features.json").read_text()) == {"row_count": 2, "first_time": "2024-01-01 00:00:00", "last_time": "2024-01-01 01:00:00", "missing": {"x": 1, "y": 2}}
