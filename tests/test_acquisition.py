"""Acquisition as a job: end states, resume after a kill, and the same table however often it is run."""

import hashlib
import http.server
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.sources import acquisition as aq
from tidemark.sources.archives import monthly_periods, with_names

MONTHS = [f"2024-{m:02d}" for m in range(1, 7)]


@pytest.fixture
def mirror(tmp_path):
    at = tmp_path / "mirror"
    at.mkdir()
    for m in MONTHS:
        name = f"X-5m-{m}.zip"
        with zipfile.ZipFile(at / name, "w") as z:
            z.writestr(name.replace(".zip", ".csv"), f"{m}\n" * 4000)
        (at / f"{name}.CHECKSUM").write_text(f"{hashlib.sha256((at / name).read_bytes()).hexdigest()}  {name}\n")
    return at


@pytest.fixture
def planned(spark):
    return with_names(monthly_periods(spark, "2024-01-01", "2024-07-01"), "X", "5m", "http://nowhere")


def rows(d):
    return sorted(tuple(r) for r in d.select("archive", "period", "status", "sha256", "size_bytes").collect())


def killed(folder):
    """A client that gives the first bytes of archives, then breaks off (a local class: it travels with the job)."""

    class Killed(aq.MirrorClient):
        def get(self, url, headers, stream, timeout):
            a = super().get(url, headers, stream, timeout)
            if url.endswith(".zip") and a.body is not None:
                a.iter_content = lambda size: self.some(a.body)
            return a

        def some(self, body):
            yield body.read(100)
            raise RuntimeError("killed")

    return Killed(folder)


def test_a_killed_run_ends_in_the_same_table(spark, planned, mirror, tmp_path):
    whole = rows(aq.acquisition_run(planned, str(tmp_path / "a"), aq.MirrorClient(str(mirror)), f"{tmp_path}/state-a"))
    assert [r[2] for r in whole] == ["VERIFIED"] * 6
    at = str(tmp_path / "b")
    with pytest.raises(Exception):  # noqa: B017 (the task dies)
        aq.acquisition_run(planned, at, killed(str(mirror)), f"{tmp_path}/state-b").count()
    states = {r.state for r in aq.acquisition_state(planned, at).collect()}
    assert "DOWNLOADING" in states and "PRESENT" not in states
    again = aq.acquisition_run(planned, at, aq.MirrorClient(str(mirror)), f"{tmp_path}/state-b")
    assert rows(again) == whole == rows(spark.read.parquet(f"{tmp_path}/state-b"))
    assert rows(aq.acquisition_run(planned, at, killed(str(mirror)))) == whole  # all there: nothing is fetched
    assert {r.state for r in aq.acquisition_state(planned, at).collect()} == {"PRESENT"}
    t = aq.acquisition_totals(again).first()
    assert (t.archives, t.verified, t.completion_status) == (6, 6, "COMPLETE") and t.bytes == sum(r[4] for r in whole)


def test_end_states(spark, planned, mirror, tmp_path):
    (mirror / "X-5m-2024-01.zip").unlink()
    (mirror / "X-5m-2024-02.zip").write_bytes(b"something else")
    (mirror / "X-5m-2024-03.zip.CHECKSUM").write_text("no digest")
    bad = b"no zip"
    (mirror / "X-5m-2024-04.zip").write_bytes(bad)
    (mirror / "X-5m-2024-04.zip.CHECKSUM").write_text(f"{hashlib.sha256(bad).hexdigest()}  X-5m-2024-04.zip\n")
    at = str(tmp_path / "d")
    first = aq.acquisition_run(planned.filter("period <= '2024-05'"), at, aq.MirrorClient(str(mirror)))
    assert [r[2] for r in rows(first)] == ["MISSING_REMOTE", "CHECKSUM_FAILED", "CHECKSUM_FAILED", "ZIP_FAILED", "VERIFIED"]
    only = aq.acquisition_run(planned, at, None, verify_only=True)
    assert [r[2] for r in rows(only)] == ["MISSING_LOCAL", "MISSING_LOCAL", "MISSING_LOCAL", "MISSING_LOCAL", "VERIFIED", "MISSING_LOCAL"]
    assert aq.acquisition_totals(only).first().completion_status == "INCOMPLETE"
    assert only.filter(F.col("status") != "VERIFIED").filter("error is null").count() == 0


def test_over_http(spark, planned, mirror, tmp_path):
    class Quiet(http.server.SimpleHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def translate_path(self, path):
            return str(mirror / path.rsplit("/", 1)[1])

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Quiet)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = planned.withColumn("url", F.concat(F.lit(f"http://127.0.0.1:{server.server_port}/"), "archive"))
        (mirror / "X-5m-2024-06.zip").unlink()
        got = rows(aq.acquisition_run(at, str(tmp_path / "h"), aq.WebClient(), retries=0))
    finally:
        server.shutdown()
    assert [r[2] for r in got] == ["VERIFIED"] * 5 + ["MISSING_REMOTE"]
