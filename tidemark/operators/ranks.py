"""Exact ranks, quantiles and rank correlations without a window over a whole group.

Order is established on distinct values with their counts: they are range-partitioned, counted
within each partition, and the partitions' totals are added up in order. A group (a feature, a
symbol) may hold any share of the rows; no task holds a whole group, and no buffer all its values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.staging import staged

ACCURACY = 10_000
#: Width of a bracket around a quantile, as a share of the rows: twice what the sketch may be off.
SLACK = 2.0 / ACCURACY


def with_counts_before(counts: DataFrame, keys: Sequence[str], value: str, n: str = "n") -> DataFrame:
    """``counts`` (keys, value, n; one row a value) with before: rows of the group with a smaller value."""
    spark = counts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = staged(counts.repartitionByRange(parts, *keys, value).withColumn("_part", F.spark_partition_id()), "value-counts")
    totals = placed.groupBy("_part", *keys).agg(F.sum(n).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_earlier"))
    inside = Window.partitionBy("_part", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    d = placed.withColumn("_inside", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    same = d["_part"] == totals["_part"]
    for k in keys:
        same = same & d[k].eqNullSafe(totals[k])
    return d.join(totals, same).select(*(d[k] for k in keys), d[value], d[n], (F.col("_inside") + F.col("_earlier")).cast("long").alias("before"))


def average_ranks(d: DataFrame, keys: Sequence[str], value: str, rank: str = "rank") -> DataFrame:
    """``d`` with ranks from 1 within each group, ties share their mean; rows without a value are left out."""
    d = d.filter(F.col(value).isNotNull())
    order = with_counts_before(d.groupBy(*keys, value).agg(F.count("*").alias("_n")), keys, value, "_n")
    ranks = order.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(value).alias("_v"), (F.col("before") + (F.col("_n") + 1) / 2.0).alias(rank))
    same = F.col(value) == F.col("_v")
    for i, k in enumerate(keys):
        same = same & d[k].eqNullSafe(F.col(f"_k{i}"))
    return d.join(ranks, same).drop("_v", *(f"_k{i}" for i in range(len(keys))))


def exact_quantiles(d: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, one column a share): linear quantiles, exact, of the rows with a value.

    A quantile sketch of bounded size brackets each quantile; the rows below a bracket are counted
    and only the values inside it are put in order.
    """
    x = F.col(value)
    d = d.filter(x.isNotNull()).select(*keys, value)
    asked = sorted({min(1.0, max(0.0, s)) for p in shares.values() for s in (p - SLACK, p + SLACK)})
    edge = F.percentile_approx(x, F.lit(asked), F.lit(ACCURACY))
    brackets = d.groupBy(*keys).agg(F.count("*").alias("_rows"), F.min(x).alias("_least"), F.max(x).alias("_most"), edge.alias("_edges"))
    place = lambda s: asked.index(min(1.0, max(0.0, s)))
    low = lambda p: F.when(F.lit(p - SLACK <= 0), F.col("_least")).otherwise(F.col("_edges")[place(p - SLACK)])
    high = lambda p: F.when(F.lit(p + SLACK >= 1), F.col("_most")).otherwise(F.col("_edges")[place(p + SLACK)])
    wanted = F.array(*(F.struct(F.lit(name).alias("_name"), F.lit(float(p)).alias("_share"), low(p).alias("_low"), high(p).alias("_high")) for name, p in shares.items()))
    brackets = staged(brackets.select(*keys, "_rows", F.inline(wanted)), "quantile-brackets")
    both = _joined(d, brackets, keys)
    # the two values that a quantile lies between may be just beyond the bracket of a small group
    below = both.groupBy(*keys, "_name").agg(F.count_if(x < F.col("_low")).alias("_below"), F.max(F.when(x < F.col("_low"), x)).alias("_under"), F.min(F.when(x > F.col("_high"), x)).alias("_over"))
    inside = both.filter((x >= F.col("_low")) & (x <= F.col("_high"))).groupBy(*keys, "_name", value).agg(F.count("*").alias("n"))
    order = _joined(with_counts_before(inside, [*keys, "_name"], value), _joined(below, brackets, [*keys, "_name"]), [*keys, "_name"])
    at = (F.col("_rows") - 1) * F.col("_share")
    first = F.col("_below") + F.col("before")
    holds = lambda k: F.max(F.when((first <= k) & (k < first + F.col("n")), F.col(value)))
    near = lambda k: F.coalesce(holds(k), F.max(F.when(k < F.col("_below"), F.col("_under")).otherwise(F.col("_over"))))
    found = order.groupBy(*keys, "_name").agg(near(F.floor(at)).alias("_a"), near(F.ceil(at)).alias("_b"), F.first(at - F.floor(at)).alias("_w"))
    exact = found.withColumn("_q", F.col("_a") + F.col("_w") * (F.col("_b") - F.col("_a")))
    return exact.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name) for name in shares))


def _joined(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which null keys are equal; ``b``'s keys are dropped."""
    b = b.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & a[k].eqNullSafe(b[f"_r_{k}"])
    return a.join(b, same).drop(*(f"_r_{k}" for k in keys))


def mask_of(features: Sequence[str]) -> list[Column]:
    """For each feature: how many rows lack it and a fingerprint of which ones."""
    row = F.xxhash64("_row")
    return [F.struct(F.count_if(missing).alias("n"), F.coalesce(F.bit_xor(F.when(missing, row)), F.lit(0).cast("long")).alias("h")).alias(f) for f, missing in ((f, F.col(f).isNull()) for f in features)]


def spearman_matrix(wide: DataFrame, row_keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(left_feature, right_feature, pairs, rho, identical) of every two features over the rows that have both.

    Features that are missing in the same rows form a class. The rows that two features share depend
    on their classes alone, so each feature is ranked once for each such set of rows, not once a
    pair, and the correlations of a set come from sums of products of its ranks, block by block
    within tasks. ``identical``: 1 where the two values are equal in all shared rows. Pairs without
    a shared row have no row here.
    """
    spark = wide.sparkSession
    key = F.struct(*row_keys)
    rows = staged(wide.select(F.xxhash64(key).alias("_row"), *(F.col(f).cast("double").alias(f) for f in features)), "feature-rows")
    total = rows.agg(F.count("*").alias("_total"), *mask_of(features)).first()
    classes: dict[tuple, list[str]] = {}
    for f in features:
        if total[f]["n"] < total["_total"]:
            classes.setdefault((total[f]["n"], total[f]["h"]), []).append(f)
    heads = [own[0] for own in classes.values()]
    members = {own[0]: own for own in classes.values()}
    couples = [(a, b) for i, a in enumerate(heads) for b in heads[i:]]
    empty = spark.createDataFrame([], "left_feature string, right_feature string, pairs long, rho double, identical int")
    if not couples:
        return empty
    # sets of rows: couples of classes that lack the same rows together share one
    lacks = [F.struct(F.count_if(m).alias("n"), F.coalesce(F.bit_xor(F.when(m, F.xxhash64("_row"))), F.lit(0).cast("long")).alias("h")).alias(f"c{i}") for i, m in enumerate(F.col(a).isNull() | F.col(b).isNull() for a, b in couples)]
    found = rows.agg(*lacks).first()
    sets: dict[tuple, list[tuple[str, str]]] = {}
    for i, couple in enumerate(couples):
        if found[f"c{i}"]["n"] < total["_total"]:
            sets.setdefault((found[f"c{i}"]["n"], found[f"c{i}"]["h"]), []).append(couple)
    cells, wanted = [], {}
    for number, own in enumerate(sets.values()):
        used = sorted({f for a, b in own for h in (a, b) for f in members[h]})
        wanted[number] = ({f: i for i, f in enumerate(used)}, {tuple(sorted((x, y))) for a, b in own for x in members[a] for y in members[b] if x != y})
        there = F.col(own[0][0]).isNotNull() & F.col(own[0][1]).isNotNull()
        cells.append(F.when(there, F.struct(F.lit(number).alias("set"), F.array(*(F.struct(F.lit(i).alias("f"), F.col(f).alias("x")) for i, f in enumerate(used))).alias("values"))))
    if not any(pairs for _, pairs in wanted.values()):
        return empty
    long = rows.select("_row", F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull()))).select("_row", "set", F.inline("values"))
    ranked = average_ranks(long, ["set", "f"], "x")
    vectors = ranked.groupBy("set", "_row").agg(F.array_sort(F.collect_list(F.struct("f", "rank", "x"))).alias("v"))
    width = {number: len(place) for number, (place, _) in wanted.items()}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            which = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            flat, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            rank, x = flat.field(1).to_numpy(zero_copy_only=False), flat.field(2).to_numpy(zero_copy_only=False)
            for number in np.unique(which).tolist():
                w = width[number]
                at = (ends[which == number] - w)[:, None] + np.arange(w)
                r, v = rank[at], x[at]
                own = total.setdefault(number, np.zeros((4, w, w)))
                own[0] += r.T @ r
                own[1] += r.sum(axis=0)[:, None]
                own[2] += len(r)
                for k in range(w):
                    own[3, k] += (v == v[:, k : k + 1]).sum(axis=0)
        if total:
            yield pa.RecordBatch.from_pydict({"set": pa.array(list(total), pa.int32()), "sums": pa.array([t.tobytes() for t in total.values()], pa.binary())})

    # a few small matrices a task, added up by a few tasks
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(s, float)
                total[number] = total[number] + own if number in total else own
        if total:
            yield pa.RecordBatch.from_pydict({"set": pa.array(list(total), pa.int32()), "sums": pa.array([t.tobytes() for t in total.values()], pa.binary())})

    parts = vectors.select("set", "v").mapInArrow(sums, "set int, sums binary").repartition(8).mapInArrow(add, "set int, sums binary").collect()
    out = []
    for number, (place, pairs) in wanted.items():
        w = width[number]
        own = np.sum([np.frombuffer(p["sums"], float) for p in parts if p["set"] == number], axis=0).reshape(4, w, w)
        n = own[2, 0, 0]
        mean = own[1, :, 0] / n
        cov = own[0] / n - np.outer(mean, mean)
        for left, right in sorted(pairs):
            i, j = place[left], place[right]
            spread = cov[i, i] * cov[j, j]
            rho = float(cov[i, j] / np.sqrt(spread)) if cov[i, i] > 1e-9 and cov[j, j] > 1e-9 else None
            out.append((left, right, int(n), rho, int(own[3, i, j] == n)))
    return spark.createDataFrame(out, empty.schema)
