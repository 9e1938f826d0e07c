"""Monthly ZIP archives of raw five-minute rows: names, checksums, scans and the canonical table."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expressions import from_micros
from tidemark.operators import validation as v
from tidemark.shipping import ship_package
from tidemark.sources.schemas import RAW_FIELDS

FIVE_MINUTES = 300_000_000
_LINE = re.compile(r"([0-9a-fA-F]{64})\s+\*?(\S+)")


def monthly_periods(spark: SparkSession, start: str, end_exclusive: str) -> DataFrame:
    """One row (period 'yyyy-MM') for every month whose first day lies before the end."""
    if start >= end_exclusive:
        raise ValueError("start must lie before end")
    months = F.sequence(F.trunc(F.lit(start).cast("date"), "MM"), F.date_sub(F.lit(end_exclusive).cast("date"), 1), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(months).alias("m")).select(F.date_format("m", "yyyy-MM").alias("period"))


def with_names(periods: DataFrame, symbol: str, interval: str, base_url: str) -> DataFrame:
    """archive, checksum, path and url of every period."""
    archive = F.format_string(f"{symbol}-{interval}-%s.zip", "period")
    path = F.concat(F.lit(f"/data/spot/monthly/klines/{symbol}/{interval}/"), archive)
    return periods.withColumns({"archive": archive, "checksum": F.concat(archive, F.lit(".CHECKSUM")), "path": path, "url": F.concat(F.lit(base_url.rstrip("/")), path)})


def parse_checksum(text: str, expected_name: str) -> str:
    """The digest of a checksum file of one line that names the expected archive, in lower case."""
    lines = [x for x in text.splitlines() if x.strip()]
    m = _LINE.fullmatch(lines[0].strip()) if len(lines) == 1 else None
    if not m or m[2] != expected_name:
        raise ValueError(f"not a checksum of {expected_name}")
    return m[1].lower()


def checksums(spark: SparkSession, pattern: str) -> DataFrame:
    """(archive, expected_sha256) of checksum files; a malformed one has a NULL digest."""
    d = spark.read.text(pattern, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.CHECKSUM$", 1).alias("archive"), F.trim("value").alias("t"))
    name, digest = F.regexp_extract("t", r"^[0-9a-fA-F]{64}\s+\*?(\S+)$", 1), F.lower(F.regexp_extract("t", r"^([0-9a-fA-F]{64})\s", 1))
    return d.select("archive", F.when((name == F.col("archive")) & (digest != ""), digest).alias("expected_sha256"))


def archive_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(archive, period, size_bytes, sha256, content) of archive files."""
    d = spark.read.format("binaryFile").load(pattern)
    archive = F.regexp_extract("path", r"([^/]+)$", 1)
    return d.select(archive.alias("archive"), F.regexp_extract(archive, r"-(\d{4}-\d{2})\.zip$", 1).alias("period"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content")


def opened(content: bytes) -> tuple[str, list[tuple[int, list[str]]]]:
    """Status of a ZIP (VALID, ZIP_FAILED, EXTRA_MEMBERS) and its CSV rows with line numbers; a header line is dropped."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if z.testzip() is not None:
                return "ZIP_FAILED", []
            names = [n for n in z.namelist() if n.endswith(".csv")]
            if not names:
                return "ZIP_FAILED", []
            status = "VALID" if len(z.namelist()) == 1 else "EXTRA_MEMBERS"
            rows = list(enumerate(csv.reader(io.TextIOWrapper(z.open(names[0]), "utf-8")), 1))
    except (zipfile.BadZipFile, UnicodeDecodeError, OSError):
        return "ZIP_FAILED", []
    return status, [(n, r) for n, r in rows if r and not (n == 1 and r[0].strip().lower() == "open_time")]


def scan_rows(files: DataFrame) -> DataFrame:
    """(archive, period, line, twelve string fields) of all readable archives; rows of another width have NULL fields.

    One archive is one task's work; a month of five-minute rows is a few megabytes.
    """
    ship_package(files.sparkSession)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive, period, content in zip(b["archive"], b["period"], b["content"]):
                rows = opened(content)[1]
                fields = [r if len(r) == len(RAW_FIELDS) else [None] * len(RAW_FIELDS) for _, r in rows]
                out = pd.DataFrame(fields, columns=RAW_FIELDS, dtype=object)
                out.insert(0, "line", [n for n, _ in rows])
                out.insert(0, "period", period)
                out.insert(0, "archive", archive)
                yield out

    return files.select("archive", "period", "content").mapInPandas(scan, "archive string, period string, line long, " + ", ".join(f"{f} string" for f in RAW_FIELDS))


def verified_archives(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(archive, period, size_bytes, sha256, status): MISSING_CHECKSUM, CHECKSUM_FAILED, ZIP_FAILED or VERIFIED."""
    ship_package(files.sparkSession)

    def crc(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["zip_status"] = [opened(c)[0] for c in b["content"]]
            yield b.drop(columns="content")

    d = files.mapInPandas(crc, "archive string, period string, size_bytes long, sha256 string, zip_status string").join(F.broadcast(expected), "archive", "left")
    status = F.when(F.col("expected_sha256").isNull(), "MISSING_CHECKSUM").when(F.col("sha256") != F.col("expected_sha256"), "CHECKSUM_FAILED").when(F.col("zip_status") == "ZIP_FAILED", "ZIP_FAILED").otherwise("VERIFIED")
    return d.select("archive", "period", "size_bytes", "sha256", status.alias("status"))


def acquisition_plan(periods: DataFrame, files: DataFrame) -> DataFrame:
    """Every expected archive with what is there: PRESENT or PLANNED. Nothing is fetched."""
    there = files.select("archive", "size_bytes", F.lit("PRESENT").alias("status"))
    return periods.join(there, "archive", "left").withColumn("status", F.coalesce("status", F.lit("PLANNED")))


def acquisition_summary(verified: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    return verified.agg(F.count("*").alias("archives"), count("VERIFIED").alias("verified"), count("CHECKSUM_FAILED").alias("checksum_failed"), count("ZIP_FAILED").alias("zip_failed"), count("MISSING_CHECKSUM").alias("missing_checksum"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """(period, raw_open_time, corrected_us): the off-grid rows of an allow-list; a row that may not be corrected raises."""
    d = spark.read.csv(path, header=True)
    d = d.filter(F.array_contains(F.split("anomaly_types", r"\+"), "OFF_GRID"))
    fine = (F.col("mapping_status") == "UNIQUE_MISSING_GRID") & (F.col("nearest_grid_currently_absent") == "True") & (F.col("mapping_would_collide_with_existing") == "False")
    us = F.unix_micros(F.to_timestamp("nearest_grid_timestamp_utc"))
    fine = fine & (F.pmod(us, F.lit(FIVE_MINUTES)) == 0)
    return d.select(F.col("archive_month").alias("period"), "raw_open_time", F.when(fine, us).otherwise(F.raise_error(F.lit("a correction is not unique, absent and on the grid"))).alias("corrected_us"))


def canonical_rows(rows: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Typed five-minute rows; an off-grid row that the allow-list does not name raises. The list is small: it is broadcast."""
    opened_at = F.col("open_time").cast("long")
    us = v.to_micros(opened_at, v.expected_unit(F.col("period")))
    d = rows.withColumn("us", us)
    if allowed is not None:
        listed = allowed.select("period", F.col("raw_open_time").alias("open_time"), "corrected_us")
        d = d.join(F.broadcast(listed), ["period", "open_time"], "left").withColumn("us", F.coalesce("corrected_us", "us"))
    stray = F.pmod("us", F.lit(FIVE_MINUTES)) != 0
    at = F.when(stray, F.raise_error(F.concat(F.lit("off-grid row "), F.col("open_time")))).otherwise(F.col("us"))
    number = lambda c: F.col(c).cast("decimal(38,8)").alias(c)
    close: Column = from_micros(v.to_micros(F.col("close_time").cast("long"), v.expected_unit(F.col("period"))))
    return d.select(from_micros(at).alias("open_time"), *(number(c) for c in ("open", "high", "low", "close", "volume")), close.alias("close_time"), number("quote_asset_volume"), F.col("number_of_trades").cast("long").alias("number_of_trades"), number("taker_buy_base_volume"), number("taker_buy_quote_volume"), "ignore")


def unused_corrections(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """Corrections that no row asked for."""
    return allowed.join(rows.select("period", F.col("open_time").alias("raw_open_time")), ["period", "raw_open_time"], "left_anti")


def publish(df: DataFrame, path: str, check=None) -> DataFrame:
    """Write next to ``path``, verify what was written, then rename; the old table goes last.

    The old table is moved aside first and back if the new one cannot take its place; after a
    crash in between it stands complete at ``path`` + ".before".
    """
    spark = df.sparkSession
    fresh = f"{path}.writing"
    df.write.mode("overwrite").parquet(fresh)
    written = spark.read.parquet(fresh)
    if check is not None:
        check(written)
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(fresh), jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = jvm.org.apache.hadoop.fs.Path(f"{path}.before")
    replaced = fs.exists(target)
    if replaced:
        fs.delete(before, True)
        if not fs.rename(target, before):
            raise OSError(f"cannot move {path} aside")
    if not fs.rename(source, target):
        if replaced:
            fs.rename(before, target)
        raise OSError(f"cannot publish {path}")
    fs.delete(before, True)
    return spark.read.parquet(path)
