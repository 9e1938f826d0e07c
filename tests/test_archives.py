"""Raw archives with defects, the canonical table, transfers and streams."""

import datetime as dt
import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import validation as v
from tidemark.sources import archives as ar
from tidemark.sources.transfer import Transfer, TransferError
from tidemark.streaming.rollup import hourly_bars, sessions

START = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp() * 1000)


def row(k, **o):
    t = START + 300_000 * k
    base = {"open_time": t, "open": 100, "high": 110, "low": 90, "close": 105, "volume": 10, "close_time": t + 299_999, "quote": 1000, "trades": 5, "tb": 4, "tq": 400, "ignore": 0}
    return ",".join(str(x) for x in (base | o).values())


def packed(lines, extra=False):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("X-5m-2024-01.csv", "\n".join(lines))
        if extra:
            z.writestr("readme.txt", "x")
    return b.getvalue()


@pytest.fixture
def folder(tmp_path):
    return tmp_path


def files(spark, folder, content):
    (folder / "X-5m-2024-01.zip").write_bytes(content)
    return ar.archive_files(spark, f"{folder}/*.zip")


def test_periods_and_names(spark):
    assert [r.period for r in ar.monthly_periods(spark, "2020-11-17", "2021-02-01").collect()] == ["2020-11", "2020-12", "2021-01"]
    assert ar.monthly_periods(spark, "2017-08-17", "2026-08-01").count() == 108
    r = ar.with_names(ar.monthly_periods(spark, "2026-07-01", "2026-08-01"), "BTCUSDT", "5m", "https://data.example.org/").first()
    assert r.archive == "BTCUSDT-5m-2026-07.zip" and r.url == "https://data.example.org/data/spot/monthly/klines/BTCUSDT/5m/BTCUSDT-5m-2026-07.zip"
    with pytest.raises(ValueError):
        ar.monthly_periods(spark, "2021-01-01", "2021-01-01")


def test_checksum_line():
    assert ar.parse_checksum("AB" * 32 + " *a.zip\n", "a.zip") == "ab" * 32
    for bad in ("0" * 64 + "  b.zip", "0" * 63 + "  a.zip", ""):
        with pytest.raises(ValueError):
            ar.parse_checksum(bad, "a.zip")


def test_verification(spark, folder):
    content = packed([row(0)])
    f = files(spark, folder, content)
    (folder / "X-5m-2024-01.zip.CHECKSUM").write_text(hashlib.sha256(content).hexdigest() + "  X-5m-2024-01.zip\n")
    good = ar.verified_archives(f, ar.checksums(spark, f"{folder}/*.CHECKSUM"))
    assert good.first().status == "VERIFIED" and ar.acquisition_summary(good).first().verified == 1
    (folder / "X-5m-2024-01.zip.CHECKSUM").write_text("0" * 64 + "  X-5m-2024-01.zip\n")
    assert ar.verified_archives(f, ar.checksums(spark, f"{folder}/*.CHECKSUM")).first().status == "CHECKSUM_FAILED"


def test_counters(spark, folder):
    lines = ["open_time,open,high,low,close,volume,close_time,q,n,tb,tq,ignore", row(0), row(1, high=1), row(2, volume="nan"), row(3, volume=0, tb=0), row(4, open_time=START + 1_200_007), row(5, close_time=1704069299998), row(5, close_time=1704069299998), row(6), row(6, close=106), row(7, open=-1, low=-2), "1,2,3"]
    checked = v.checked_raw(ar.scan_rows(files(spark, folder, packed(lines))))
    r = v.archive_report(checked).first()
    assert r.row_count == 11 and r.parse_errors == 2 and r.off_grid == 1 and r.ohlc_violation == 1 and r.nonpositive_price == 1 and r.zero_volume == 1
    assert r.duplicate_exact == 1 and r.duplicate_conflicting == 1 and r.close_time_violation == 3 and r.validation_status == "INVALID"
    assert v.dataset_report(v.archive_report(checked)).first().verdict == "BLOCKED"
    clean = v.archive_report(v.checked_raw(ar.scan_rows(files(spark, folder, packed([row(0), row(1)])))))
    assert clean.first().validation_status == "VALID" and v.dataset_report(clean).first().verdict == "CLEAN"


def test_canonical_with_correction(spark, folder):
    rows = ar.scan_rows(files(spark, folder, packed([row(0), row(1, open_time=START + 300_007)])))
    with pytest.raises(Exception, match="off-grid"):
        ar.canonical_rows(rows).collect()
    (folder / "allow.csv").write_text(f"archive_month,raw_open_time,anomaly_types,nearest_grid_timestamp_utc,nearest_grid_currently_absent,mapping_would_collide_with_existing,mapping_status\n2024-01,{START + 300_007},OFF_GRID+CLOSE_TIME,2024-01-01T00:05:00Z,True,False,UNIQUE_MISSING_GRID\n2024-01,5,CLOSE_TIME,,,,\n")
    allowed = ar.corrections(spark, f"{folder}/allow.csv")
    d = ar.canonical_rows(rows, allowed)
    assert [r.open_time.minute for r in d.orderBy("open_time").collect()] == [0, 5] and dict(d.dtypes)["open"] == "decimal(38,8)"
    assert ar.unused_corrections(rows, allowed).count() == 0
    out = ar.publish(d, f"{folder}/canonical")
    assert out.count() == 2 and ar.publish(d.limit(1), f"{folder}/canonical").count() == 1
    failing = lambda written: 1 / 0
    with pytest.raises(ZeroDivisionError):
        ar.publish(d, f"{folder}/canonical", failing)
    assert d.sparkSession.read.parquet(f"{folder}/canonical").count() == 1


def test_broken_zip(spark, folder):
    f = files(spark, folder, b"not a zip")
    assert ar.scan_rows(f).count() == 0 and ar.opened(packed([row(0)], extra=True))[0] == "EXTRA_MEMBERS"


class Answer:
    def __init__(self, status, body=b"", **headers):
        self.status_code, self.body, self.headers = status, body, {k.replace("_", "-"): x for k, x in headers.items()}

    def iter_content(self, n):
        yield self.body


class Client:
    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def get(self, url, headers, stream, timeout):
        self.asked.append(headers)
        return self.answers.pop(0)


def test_transfer(folder):
    part = str(folder / "a.part")
    client = Client(Answer(500), Answer(200, b"abc"))
    waits = []
    assert Transfer(client, sleep=waits.append).archive("u", part) == 3 and waits == [1.0]
    client = Client(Answer(206, b"def", Content_Range="bytes 3-5/6"))
    assert Transfer(client).archive("u", part) == 6 and client.asked == [{"Range": "bytes=3-"}] and open(part, "rb").read() == b"abcdef"
    assert Transfer(Client(Answer(416, Content_Range="bytes */6"))).archive("u", part) == 6
    assert Transfer(Client(Answer(200, b"xy"))).archive("u", part) == 2
    with pytest.raises(TransferError):
        Transfer(Client(Answer(206, b"q", Content_Range="bytes 0-0/1"))).archive("u", part)
    with pytest.raises(TransferError):
        Transfer(Client(Answer(404))).archive("u", part)
    with pytest.raises(TransferError):
        Transfer(Client(*[Answer(503)] * 3), retries=2, sleep=waits.append).archive("u", part)
    digest = Transfer(Client(Answer(200, b"AB" * 32 + b"  a.zip"))).checksum("u", str(folder / "a.CHECKSUM"), "a.zip")
    assert digest == "ab" * 32


def test_streams(spark, folder):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_id", "event_type", "value")
    events.write.parquet(f"{folder}/in")
    stream = lambda: spark.readStream.schema(events.schema).parquet(f"{folder}/in")
    for name, make in (("bars", hourly_bars), ("sessions", sessions)):
        q = make(stream()).writeStream.format("memory").queryName(f"out_{name}").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(f"out_{name}").count() > 0
    late = spark.table("out_bars").agg(F.max("open_time").alias("m")).first().m
    from tidemark.sources.bars import bars

    batch = bars(events.filter("value > 0"), 60, F.col("event_type")).filter(F.col("open_time") <= F.lit(late))
    assert spark.table("out_bars").exceptAll(batch).count() == 0
