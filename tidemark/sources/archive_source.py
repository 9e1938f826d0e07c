"""A Spark data source of raw archives (one partition an archive, period filters pushed), and their writer.

    register(spark)
    spark.read.format("market_archives").load("/data/archives").filter("period >= '2024-01'")
"""

from __future__ import annotations

import csv
import hashlib
import io
import re
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from tidemark.shipping import ship_package
from tidemark.sources.schemas import RAW_FIELDS

_NAME = re.compile(r"(?P<symbol>.+)-(?P<interval>[^-]+)-(?P<period>\d{4}-\d{2})\.zip")
SCHEMA = "archive string, period string, line long, " + ", ".join(f"{f} string" for f in RAW_FIELDS)
ROWS_AT_ONCE = 10_000
LEAST_BYTES = 22  # of an empty ZIP


def opened_fs(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path:
        return pafs.LocalFileSystem(), path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path)


class ArchivePartition(ds.InputPartition):
    def __init__(self, path: str, archive: str, period: str):
        super().__init__(None)
        self.path, self.archive, self.period = path, archive, period


class ArchiveReader(ds.DataSourceReader):
    """Lists the folder once; archives whose period no filter admits are never opened."""

    def __init__(self, folder: str):
        self.folder = folder
        self.admitted: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        known = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<=", ds.In: "in"}
        for f in filters:
            if type(f) in known and f.attribute == ("period",):
                self.admitted.append((known[type(f)], f.value))
            elif not (isinstance(f, ds.IsNotNull) and f.attribute in (("period",), ("archive",), ("line",))):
                yield f

    def _admits(self, period: str) -> bool:
        tests = {"=": lambda v: period == v, ">": lambda v: period > v, ">=": lambda v: period >= v, "<": lambda v: period < v, "<=": lambda v: period <= v, "in": lambda v: period in v}
        return all(tests[op](v) for op, v in self.admitted)

    def partitions(self) -> list[ArchivePartition]:
        fs, folder = opened_fs(self.folder)
        found = []
        for info in sorted(fs.get_file_info(pafs.FileSelector(folder)), key=lambda i: i.base_name):
            m = _NAME.fullmatch(info.base_name)
            if m and self._admits(m["period"]):
                found.append(ArchivePartition(info.path, info.base_name, m["period"]))
        return found

    def read(self, partition: ArchivePartition | None) -> Iterator[pa.RecordBatch]:
        """Rows as they stand, streamed line by line; a header line is dropped, rows of another width have NULL fields.

        An archive that is no ZIP, or without a CSV member, has no rows; verification reports it.
        """
        if partition is None:  # no archive is left
            return
        fs, _ = opened_fs(self.folder)
        n = len(RAW_FIELDS)
        with fs.open_input_file(partition.path) as f:
            if f.size() < LEAST_BYTES:
                return
            try:
                z = zipfile.ZipFile(f)
                member = next((x for x in z.namelist() if x.endswith(".csv")), None)
            except zipfile.BadZipFile:
                return
            if member is None:
                return
            rows: list[list] = []
            lines: list[int] = []
            with z.open(member) as raw:
                for line, row in enumerate(csv.reader(io.TextIOWrapper(raw, "utf-8")), 1):
                    if not row or (line == 1 and row[0].strip().lower() == "open_time"):
                        continue
                    rows.append(row if len(row) == n else [None] * n)
                    lines.append(line)
                    if len(rows) == ROWS_AT_ONCE:
                        yield self._batch(partition, lines, rows)
                        rows, lines = [], []
            if rows:
                yield self._batch(partition, lines, rows)

    def _batch(self, partition: ArchivePartition, lines: list[int], rows: list[list]) -> pa.RecordBatch:
        columns = [pa.array(c, pa.string()) for c in zip(*rows)]
        k = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([partition.archive] * k), pa.array([partition.period] * k), pa.array(lines, pa.int64()), *columns], names=["archive", "period", "line", *RAW_FIELDS])


class ArchiveSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "market_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)


def write_archives(rows: DataFrame, folder: str, symbol: str, interval: str = "5m") -> DataFrame:
    """Write raw rows (period, line, twelve string fields) as one ZIP and checksum file a period; (archive, period, size_bytes, sha256).

    One period is one group: a month of five-minute rows. Files are written under a temporary name
    and then moved, so a task that runs again leaves the same files.
    """
    ship_package(rows.sparkSession)

    def write(d: pd.DataFrame) -> pd.DataFrame:
        period = d["period"].iloc[0]
        archive = f"{symbol}-{interval}-{period}.zip"
        text = d.sort_values("line")[RAW_FIELDS].to_csv(index=False, header=False, lineterminator="\n")
        made = io.BytesIO()
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(zipfile.ZipInfo(archive.replace(".zip", ".csv")), text, zipfile.ZIP_DEFLATED)
        content = made.getvalue()
        digest = hashlib.sha256(content).hexdigest()
        fs, path = opened_fs(folder)
        fs.create_dir(path, recursive=True)
        for name, data in ((archive, content), (f"{archive}.CHECKSUM", f"{digest}  {archive}\n".encode())):
            with fs.open_output_stream(f"{path}/.{name}.writing") as out:
                out.write(data)
            fs.move(f"{path}/.{name}.writing", f"{path}/{name}")
        return pd.DataFrame({"archive": [archive], "period": [period], "size_bytes": [len(content)], "sha256": [digest]})

    fields = rows.select("period", F.col("line").cast("long").alias("line"), *RAW_FIELDS)
    return fields.groupBy("period").applyInPandas(write, "archive string, period string, size_bytes long, sha256 string")
