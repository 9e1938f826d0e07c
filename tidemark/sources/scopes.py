"""Stored split bounds, and loaders that read one period of a stored sample table by them.

A split is decided once (``split_bounds``: a row a symbol) and stored beside the samples. A loader
turns it into literal predicates on the time columns, which Parquet checks against its row groups
before any row is read; a table sorted by time is read in one stretch. Rows that a period does not
keep, targets that reach the next one above all, never leave the scan's filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.diagnostics import checked
from tidemark.operators.splits import frozen_split

SCOPES = {"train": ("train",), "validation": ("validation",), "test": ("test",), "development": ("train", "validation")}
#: More symbols than this share one predicate over all their bounds, and a join narrows it.
MOST_LITERALS = 64


def split_bounds(samples: DataFrame) -> DataFrame:
    """(symbol, split, start, end, target_end, rows_kept): decisions from start to before end, targets before target_end.

    Ends are those of the next period; the last period ends after its last row.
    """
    d = frozen_split(samples.select("symbol", "decision_time", "target_time"))
    own = d.groupBy("symbol", "split").agg(F.min("decision_time").alias("start"), F.max("decision_time").alias("last"), F.max("target_time").alias("last_target"), F.count_if(~F.col("purged")).alias("rows_kept"))
    order = {"train": "validation", "validation": "test"}
    following = own.select("symbol", F.expr("case split when 'validation' then 'train' when 'test' then 'validation' end").alias("split"), F.col("start").alias("next")).filter(F.col("split").isin(*order))
    d = own.join(following, ["symbol", "split"], "left")
    just_after = lambda c: F.col(c) + F.expr("interval 1 microsecond")
    return d.select("symbol", "split", "start", F.coalesce("next", just_after("last")).alias("end"), F.coalesce("next", just_after("last_target")).alias("target_end"), "rows_kept")


def write_samples(samples: DataFrame, path: str) -> None:
    """``samples`` as Parquet, ordered by symbol and decision time within files of neighbouring rows."""
    samples.repartitionByRange("symbol", "decision_time").sortWithinPartitions("symbol", "decision_time").write.parquet(path)


def _within(start, end, target_end) -> Column:
    return (F.col("decision_time") >= F.lit(start)) & (F.col("decision_time") < F.lit(end)) & (F.col("target_time") < F.lit(target_end))


def load_scope(spark: SparkSession, samples_path: str, bounds_path: str, scope: str, columns: list[str] | None = None, verify: bool = True) -> DataFrame:
    """The kept rows of one scope, with ``split``; only ``columns`` (and the times) are read.

    Bounds are a row a symbol and split. With ``verify``, a number of rows other than the stored one raises.
    """
    bounds = spark.read.parquet(bounds_path).filter(F.col("split").isin(*SCOPES[scope]))
    d = spark.read.parquet(samples_path)
    if columns is not None:
        d = d.select("symbol", "decision_time", "target_time", *[c for c in columns if c not in ("symbol", "decision_time", "target_time")])
    known = bounds.limit(MOST_LITERALS + 1).collect()
    if len(known) <= MOST_LITERALS:
        each = [(F.col("symbol") == r["symbol"]) & _within(r["start"], r["end"], r["target_end"]) for r in known]
        d = d.filter(reduce(lambda a, b: a | b, each) if each else F.lit(False))
    else:
        span = bounds.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("target_end").alias("target_end")).first()
        d = d.filter(_within(span["start"], span["end"], span["target_end"]))
    own = bounds.select(F.col("symbol").alias("_s"), "split", "start", "end", "target_end", "rows_kept")
    inside = (F.col("symbol") == F.col("_s")) & (F.col("decision_time") >= F.col("start")) & (F.col("decision_time") < F.col("end")) & (F.col("target_time") < F.col("target_end"))
    d = d.join(own, inside)
    if verify:
        counted = d.groupBy("_s", "split").agg(F.count("*").alias("_n"))
        apart = own.select("_s", "split", "rows_kept").join(counted, ["_s", "split"], "left").agg(F.count_if(F.coalesce("_n", F.lit(0)) != F.col("rows_kept")).alias("_apart"))
        none = checked(apart, F.col("_apart") == 0, "rows of a scope differ from the stored number").filter("_apart < 0")  # never a row
        kept = d.select(*[c for c in d.columns if c not in ("_s", "start", "end", "target_end", "rows_kept")])
        return kept.unionByName(none.select(*(F.lit(None).cast(kind).alias(c) for c, kind in kept.dtypes)))
    return d.drop("_s", "start", "end", "target_end", "rows_kept")
