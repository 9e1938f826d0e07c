"""The archive data source, the raw summary, split scopes and the ordered fold."""

import datetime as dt
import zipfile

import pytest

from tidemark.operators import raw_summary as rs
from tidemark.operators import validation as v
from tidemark.sources import archive_source as src
from tidemark.sources import scopes
from tidemark.sources.schemas import RAW_FIELDS
from tidemark.streaming.fold import ordered_hours

STEP = 300_000
T0 = dt.datetime(2024, 1, 1)


def row(ms, **change):
    d = {"open_time": str(ms), "open": "100", "high": "110", "low": "90", "close": "105", "volume": "10", "close_time": str(ms + STEP - 1), "quote_asset_volume": "1000", "number_of_trades": "3", "taker_buy_base_volume": "4", "taker_buy_quote_volume": "400", "ignore": "0"} | change
    return [d[f] for f in RAW_FIELDS]


def ms(day, slot=0, month=1):
    return int(dt.datetime(2024, month, day, tzinfo=dt.UTC).timestamp() * 1000) + slot * STEP


def archived(folder, months):
    folder.mkdir(exist_ok=True)
    for period, rows in months.items():
        with zipfile.ZipFile(folder / f"X-5m-{period}.zip", "w") as z:
            z.writestr(f"X-5m-{period}.csv", "\n".join(",".join(r) for r in rows) + "\n")
    return str(folder)


@pytest.fixture
def loaded(spark):
    src.register(spark)
    return lambda folder: spark.read.format("market_archives").load(folder)


def test_source_reads_rows_as_they_stand(spark, loaded, tmp_path):
    at = archived(tmp_path / "a", {"2024-01": [["open_time", *RAW_FIELDS[1:]], row(ms(1)), ["1", "2"], row(ms(1, 1), ignore='"a, b"')], "2024-02": [row(ms(1, 0, 2))]})
    (tmp_path / "a" / "X-5m-2024-03.zip").write_bytes(b"no archive")
    (tmp_path / "a" / "notes.txt").write_text("x")
    got = loaded(at).orderBy("period", "line").collect()
    assert [(r.period, r.line) for r in got] == [("2024-01", 2), ("2024-01", 3), ("2024-01", 4), ("2024-02", 1)]
    assert got[1].open_time is None and got[2].ignore == "a, b" and got[0].archive == "X-5m-2024-01.zip"


def test_period_filters_reach_the_source(spark, loaded, tmp_path):
    at = archived(tmp_path / "a", {f"2024-{m:02d}": [row(ms(1, 0, m))] for m in range(1, 9)})
    d = loaded(at)
    for condition, months in (("period = '2024-03'", 1), ("period >= '2024-03' and period < '2024-06'", 3), ("period in ('2024-01', '2024-08', '2023-01')", 2), ("period > '2024-08'", 0), ("period > '2024-06' and open = '100'", 2), ("open = '1'", 8)):
        own = d.filter(condition)
        assert own.rdd.getNumPartitions() == max(months, 1), condition
        assert own.count() == (0 if condition == "open = '1'" else months), condition
    reader = src.ArchiveReader(at)
    list(reader.pushFilters([src.ds.GreaterThan(("period",), "2024-06")]))
    assert [p.period for p in reader.partitions()] == ["2024-07", "2024-08"]


def test_written_archives_are_read_back(spark, loaded, tmp_path):
    rows = [("2024-01", i + 1, *row(ms(1, i))) for i in range(5)] + [("2024-02", 1, *row(ms(1, 0, 2)))]
    d = spark.createDataFrame(rows, "period string, line long, " + ", ".join(f"{f} string" for f in RAW_FIELDS))
    manifest = {r.period: r for r in src.write_archives(d, str(tmp_path / "w"), "X").collect()}
    again = {r.period: r for r in src.write_archives(d, str(tmp_path / "w"), "X").collect()}
    assert {p: r.sha256 for p, r in manifest.items()} == {p: r.sha256 for p, r in again.items()}  # a task that runs again leaves the same files
    assert loaded(str(tmp_path / "w")).drop("archive").exceptAll(d).count() == 0 and loaded(str(tmp_path / "w")).count() == 6


def summary(spark, loaded, folder, months, cutoff):
    return rs.raw_summary(v.checked_raw(loaded(archived(folder, months))), cutoff * 1000).first()


def test_clean_set(spark, loaded, tmp_path):
    got = summary(spark, loaded, tmp_path / "a", {"2024-01": [row(ms(31, i)) for i in range(288)], "2024-02": [row(ms(1, i, 2)) for i in range(6)]}, ms(1, 6, 2))
    assert (got.dataset_quality_decision, got.expected_candle_count, got.missing_candle_count, got.gap_episode_count, got.valid_archive_count) == ("CLEAN", 294, 0, 0, 2)
    assert got.global_ordering_monotonic and got.cross_month_gap_count == 0 and got.missing_percentage == 0


def test_defects_are_counted(spark, loaded, tmp_path):
    jan = [row(ms(31, 280)), row(ms(31, 281), close_time=str(ms(31, 282))), row(ms(31, 282), high="1"), row(ms(31, 283), volume="0", quote_asset_volume="0", taker_buy_base_volume="0", taker_buy_quote_volume="0", ignore="7"), row(ms(31, 283), close="104"), row(ms(31, 280)), row(ms(31, 284) + 1000), row(ms(31, 285), open="nan"), row(ms(31, 286), number_of_trades="-1"), ["x"]]
    feb = [row(ms(31, 287)), row(ms(1, 2, 2)), row(ms(1, 3, 2), taker_buy_base_volume="11")]
    got = summary(spark, loaded, tmp_path / "a", {"2024-01": jan, "2024-02": feb}, ms(1, 6, 2))
    want = {"total_row_count": 13, "malformed_row_count": 1, "nan_count": 1, "close_time_violation_count": 1, "ohlc_violation_count": 1, "zero_volume_row_count": 1, "ignore_nonzero_count": 1, "exact_duplicate_row_count": 1, "conflicting_duplicate_row_count": 1, "alignment_violation_count": 1, "negative_trade_count_row_count": 1, "taker_violation_count": 1, "month_containment_violation_count": 1, "duplicate_timestamp_count": 2, "invalid_archive_count": 2, "archive_ordering_violation_count": 1, "observed_unique_timestamp_count": 10, "cross_month_overlap_count": 0, "cross_month_gap_count": 0}
    assert {k: got[k] for k in want} == want
    # the grid has slots 280 to 287 of January and 0 to 5 of February; 284, 0, 1, 4 and 5 have no row
    assert (got.expected_candle_count, got.missing_candle_count, got.gap_episode_count, got.longest_gap_candles, got.longest_gap_duration) == (14, 5, 3, 2, "PT10M")
    assert (got.dataset_quality_decision, got.execution_status) == ("REVIEW_REQUIRED", "COMPLETE")


def test_nothing_is_blocked(spark, loaded, tmp_path):
    got = summary(spark, loaded, tmp_path / "a", {}, ms(1))
    assert (got.execution_status, got.dataset_quality_decision, got.total_row_count, got.expected_candle_count) == ("BLOCKED", "BLOCKED", 0, 0)


# --- scopes -----------------------------------------------------------------------------------


@pytest.fixture
def stored(spark, tmp_path):
    rows = [(s, T0 + dt.timedelta(hours=h), T0 + dt.timedelta(hours=h + 1), float(h)) for s in ("a", "b") for h in range(0 if s == "a" else 30, 100)]
    d = spark.createDataFrame(rows, "symbol string, decision_time timestamp_ntz, target_time timestamp_ntz, y double")
    scopes.write_samples(d, str(tmp_path / "samples"))
    scopes.split_bounds(d).write.parquet(str(tmp_path / "bounds"))
    return d, str(tmp_path / "samples"), str(tmp_path / "bounds")


def test_scope_predicates_are_pushed(spark, stored):
    d, samples, bounds = stored
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    got = scopes.load_scope(spark, samples, bounds, "train", ["y"])
    plan = got._jdf.queryExecution().toString()
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line and "decision_time" in line]
    assert pushed and all("GreaterThanOrEqual(decision_time" in line and "LessThan(target_time" in line for line in pushed)
    assert sorted((r.symbol, r.y) for r in got.collect()) == [("a", float(h)) for h in range(69)] + [("b", float(h)) for h in range(30, 78)]
    assert {r.split for r in scopes.load_scope(spark, samples, bounds, "development").select("split").collect()} == {"train", "validation"}
    assert scopes.load_scope(spark, samples, bounds, "test").count() == 15 + 11


def test_scope_of_many_symbols_and_wrong_numbers(spark, stored, monkeypatch):
    d, samples, bounds = stored
    want = scopes.load_scope(spark, samples, bounds, "train").count()
    monkeypatch.setattr(scopes, "MOST_LITERALS", 1)
    assert scopes.load_scope(spark, samples, bounds, "train").count() == want
    d.filter("symbol = 'a' and y <> 5").write.mode("overwrite").parquet(samples)
    with pytest.raises(Exception, match="differ from the stored number"):
        scopes.load_scope(spark, samples, bounds, "train").count()
    assert scopes.load_scope(spark, samples, bounds, "train", verify=False).count() == 68


# --- ordered fold -----------------------------------------------------------------------------

BARS = "symbol string, open_time timestamp_ntz, open double, high double, low double, close double, volume double"


def streamed(spark, folder, batches, name):
    """Hours after each file of bars has been one batch of the stream."""
    source, sink, state = folder / "in", folder / "out", folder / "state"
    source.mkdir(exist_ok=True)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, BARS).coalesce(1).write.mode("append").parquet(str(source))
        q = ordered_hours(spark.readStream.schema(BARS).parquet(str(source))).writeStream.format("parquet").option("checkpointLocation", str(state)).option("path", str(sink)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(str(sink)).collect())


def bar(slot, symbol="X"):
    x = float(slot)
    return (symbol, T0 + dt.timedelta(minutes=5 * slot), x, x + 2, x - 2, x + 1, 1.0)


def test_fold_closes_each_hour_once_across_batches(spark, tmp_path):
    batches = [[bar(i) for i in range(0, 7)], [bar(i) for i in range(7, 25)], [bar(i) for i in range(25, 40) if i != 30] + [bar(3, "Y"), bar(40, "Y")]]
    (tmp_path / "one").mkdir()
    got = streamed(spark, tmp_path / "one", batches, "one")
    hour = lambda h, o, c, n, s="X": (s, T0 + dt.timedelta(hours=h), float(o), c + 2.0, o - 2.0, c + 1.0, float(n), n, n == 12)
    assert got == [hour(0, 0, 11, 12), hour(1, 12, 23, 12), hour(2, 24, 35, 11), hour(0, 3, 3, 1, "Y")]
    (tmp_path / "two").mkdir()
    assert streamed(spark, tmp_path / "two", [sum(batches, [])], "two") == got  # the same input in one batch


def test_fold_raises_on_disorder(spark, tmp_path):
    for k, rows in enumerate(([bar(5), bar(4)], [bar(5), bar(5)])):
        (tmp_path / str(k)).mkdir()
        with pytest.raises(Exception, match="out of order"):
            streamed(spark, tmp_path / str(k), [rows], "x")
