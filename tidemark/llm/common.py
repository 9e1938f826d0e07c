"""Shared helpers: table access, shared scratch folders, staged tables."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shipping import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Where the session has none, a session on one machine (unit tests) gets a temporary folder once;
    on a cluster that is an error, since executors share no temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage; the written table outlives any executor.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def labelled(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The label rows whose document is among ``docs``, staged: classes are counted and sampled from these."""
    return staged(rows.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi"), "labelled")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow file system and path of a folder URI (file:, hdfs:, s3:, gs:, or a plain path)."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri)


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores after it until no column of that name (in any case) is there."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


_memo: tuple = (None, None)


def worker_memo(key: tuple, make):
    """What ``make`` returns, kept in the Python worker for its next tasks; a worker keeps one such thing at a time."""
    global _memo
    if _memo[0] != key:
        _memo = (None, None)
        _memo = (key, make())
    return _memo[1]


def give_back() -> None:
    """Return to the system what Arrow's pool and the C library hold but no longer use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def frugal(work: Callable) -> Callable:
    """``work`` over a task's batches, after which its worker gives memory back: it may idle beside tasks of the JVM."""

    @functools.wraps(work)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return task


def spread(spark: SparkSession, least: int = 8) -> int:
    """Number of partitions for an explicit repartition: the session's shuffle width."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
