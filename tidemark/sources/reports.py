"""Small reports of a run: one CSV or JSON file each, complete or not there at all.

A report is a table of bounded size (a row an hour without all slots, a feature, a month). It is
written by one task under a temporary name, in a fixed order, and renamed into place; the file
system is the one of the path, so any that Spark reaches will do.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.archives import publish


def _put(spark: SparkSession, path: str, move_from: str) -> None:
    """Rename the single data file of a written folder to ``path``; an older report is replaced."""
    jvm = spark.sparkContext._jvm
    folder, target = jvm.org.apache.hadoop.fs.Path(move_from), jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]
    if len(parts) != 1:
        raise OSError(f"{len(parts)} files for one report")
    before = jvm.org.apache.hadoop.fs.Path(f"{path}.before")
    replaced = fs.exists(target)
    if replaced:
        fs.delete(before, False)
        if not fs.rename(target, before):
            raise OSError(f"cannot move {path} aside")
    if not fs.rename(parts[0], target):
        if replaced:
            fs.rename(before, target)
        raise OSError(f"cannot publish {path}")
    fs.delete(before, False)
    fs.delete(folder, True)


def csv_report(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """``df`` with a header, its rows by ``order``; missing values are empty."""
    one = df.coalesce(1).sortWithinPartitions(*order)
    one.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(f"{path}.writing")
    _put(df.sparkSession, path, f"{path}.writing")


def json_report(df: DataFrame, path: str) -> None:
    """A table of one row as a JSON object, keys sorted; doubles that are no numbers are null."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a JSON report has one row")
    clean = {k: None if isinstance(v, float) and v != v else v for k, v in rows[0].asDict(recursive=True).items()}
    text = json.dumps(clean, indent=2, sort_keys=True, default=str)
    spark = df.sparkSession
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.writing")
    _put(spark, path, f"{path}.writing")


def feature_artifact(features: DataFrame, path: str, names: Sequence[str]) -> DataFrame:
    """Write a feature table with its summary (``path``.json): rows, first and last time, and missing values of each feature."""
    written = publish(features, path)
    summary = written.agg(F.count("*").alias("row_count"), F.min("open_time").cast("string").alias("first_time"), F.max("open_time").cast("string").alias("last_time"), F.struct(*(F.count_if(F.col(n).isNull()).alias(n) for n in names)).alias("missing"))
    json_report(summary, f"{path}.json")
    return written
