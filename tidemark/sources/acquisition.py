"""Acquisition of archives as a Spark job: plan, transfer, verification and state, one archive a unit of work.

The destination is a folder that all executors mount. What a task has done lies there: a checksum
file, a partial archive that the next attempt goes on with, or an archive renamed into place once
its digest and CRC are right. So a run that was killed is simply run again; archives that are there
are verified, not fetched, and both ways end in the same table.
"""

from __future__ import annotations

import hashlib
import os
import re
import urllib.error
import urllib.request
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shipping import ship_package
from tidemark.sources.archives import parse_checksum, publish
from tidemark.sources.transfer import Transfer, TransferError

#: End states of an archive; all but the first leave it out of the data set.
STATES = ("VERIFIED", "MISSING_LOCAL", "MISSING_REMOTE", "FORBIDDEN_REMOTE", "CHECKSUM_FAILED", "ZIP_FAILED", "DOWNLOAD_FAILED")
OUT = "archive string, period string, status string, sha256 string, size_bytes long, error string"
_STATUS = re.compile(r"status (\d+)$")


class Answer:
    """What ``Transfer`` reads of an HTTP answer."""

    def __init__(self, status: int, headers: dict[str, str], body: Any = None):
        self.status_code, self.headers, self.body = status, headers, body

    def iter_content(self, size: int) -> Iterator[bytes]:
        while self.body is not None and (chunk := self.body.read(size)):
            yield chunk


class WebClient:
    """HTTP by the standard library."""

    def get(self, url: str, headers: dict[str, str], stream: bool, timeout: float) -> Answer:
        try:
            r = urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout)
            return Answer(r.status, dict(r.headers), r)
        except urllib.error.HTTPError as e:
            return Answer(e.code, dict(e.headers))
        except OSError as e:
            raise TransferError(f"{url}: {e}", retry=True) from e


@dataclass
class MirrorClient:
    """A mounted mirror in place of a server: the url's last part is looked up in ``folder``; ranges as HTTP has them."""

    folder: str

    def get(self, url: str, headers: dict[str, str], stream: bool, timeout: float) -> Answer:
        path = os.path.join(self.folder, url.rsplit("/", 1)[1])
        if not os.path.exists(path):
            return Answer(404, {})
        size = os.path.getsize(path)
        start = int(headers["Range"].removeprefix("bytes=").rstrip("-")) if "Range" in headers else 0
        if "Range" in headers and start >= size:
            return Answer(416, {"Content-Range": f"bytes */{size}"})
        body = open(path, "rb")
        body.seek(start)
        return Answer(206, {"Content-Range": f"bytes {start}-{size - 1}/{size}"}, body) if "Range" in headers else Answer(200, {}, body)


def digest_of(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            h.update(chunk)
    return h.hexdigest()


def verified(path: str, expected: str) -> str:
    """VERIFIED, CHECKSUM_FAILED or ZIP_FAILED of an archive, read in pieces."""
    if digest_of(path) != expected:
        return "CHECKSUM_FAILED"
    try:
        with zipfile.ZipFile(path) as z:
            return "VERIFIED" if z.testzip() is None and z.namelist() else "ZIP_FAILED"
    except zipfile.BadZipFile:
        return "ZIP_FAILED"


def acquired(archive: str, url: str, destination: str, transfer: Transfer | None) -> tuple[str, str | None]:
    """(status, error) of one archive after this attempt; without ``transfer`` nothing is fetched."""
    target, sums = os.path.join(destination, archive), os.path.join(destination, f"{archive}.CHECKSUM")
    try:
        if os.path.exists(sums):
            with open(sums, encoding="utf-8") as f:
                expected = parse_checksum(f.read(), archive)
        elif transfer is None:
            return "MISSING_LOCAL", "no checksum file"
        else:
            expected = transfer.checksum(f"{url}.CHECKSUM", sums, archive)
        if not os.path.exists(target):
            if transfer is None:
                return "MISSING_LOCAL", "no archive"
            transfer.archive(url, f"{target}.part")
            status = verified(f"{target}.part", expected)
            if status != "VERIFIED":
                os.remove(f"{target}.part")  # the next attempt begins anew
                return status, "the fetched archive is not the expected one"
            os.replace(f"{target}.part", target)
            return status, None
        status = verified(target, expected)
        return status, None if status == "VERIFIED" else "the local archive is not the expected one"
    except ValueError as e:
        return "CHECKSUM_FAILED", str(e)
    except TransferError as e:
        m = _STATUS.search(str(e))
        return {"404": "MISSING_REMOTE", "403": "FORBIDDEN_REMOTE"}.get(m[1] if m else "", "DOWNLOAD_FAILED"), str(e)


def acquisition_run(planned: DataFrame, destination: str, client: Any, state_path: str | None = None, verify_only: bool = False, retries: int = 3, first_wait: float = 1.0) -> DataFrame:
    """(archive, period, status, sha256, size_bytes, error) of every planned archive (period, archive, url).

    Archives are spread over tasks, one after the other within each. With ``state_path`` the table
    is published there, complete or not at all.
    """
    spark = planned.sparkSession
    ship_package(spark)
    os.makedirs(destination, exist_ok=True)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transfer = None if verify_only else Transfer(client, retries=retries, first_wait=first_wait)
        for batch in batches:
            for r in batch.itertuples():
                status, error = acquired(r.archive, r.url, destination, transfer)
                path = os.path.join(destination, r.archive)
                good = status == "VERIFIED"
                yield pd.DataFrame({"archive": [r.archive], "period": [r.period], "status": [status], "sha256": [digest_of(path) if good else None], "size_bytes": pd.array([os.path.getsize(path) if good else None], "Int64"), "error": [error]})

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = planned.select("archive", "period", "url").repartition(tasks, "archive").mapInPandas(work, OUT)
    return publish(d, state_path) if state_path else d


def acquisition_state(planned: DataFrame, destination: str) -> DataFrame:
    """(archive, period, state) by what lies in the destination now: PRESENT, DOWNLOADING or PLANNED. Nothing is fetched or verified."""
    ship_package(planned.sparkSession)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = [os.path.join(destination, a) for a in b["archive"]]
            b["state"] = ["PRESENT" if os.path.exists(p) else "DOWNLOADING" if os.path.exists(f"{p}.part") else "PLANNED" for p in at]
            yield b

    return planned.select("archive", "period").mapInPandas(look, "archive string, period string, state string")


def acquisition_totals(run: DataFrame) -> DataFrame:
    """One row: archives of each end state, bytes, and COMPLETE where all are verified."""
    n = {s: F.count_if(F.col("status") == s).alias(s.lower()) for s in STATES}
    d = run.agg(F.count("*").alias("archives"), *n.values(), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    return d.withColumn("completion_status", F.when((F.col("archives") > 0) & (F.col("verified") == F.col("archives")), "COMPLETE").otherwise("INCOMPLETE"))
