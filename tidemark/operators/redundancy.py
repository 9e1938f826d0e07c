"""Equal, affine and rank-equivalent columns of two feature sets, and windows of both for the same decisions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import HOUR, micros
from tidemark.operators.ranks import spearman_matrix
from tidemark.staging import staged

CLOSE = 1e-12
RESIDUAL = 1e-10


def cross_equivalence(wide: DataFrame, keys: Sequence[str], left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """(feature, f0_feature, pairs, exact, affine, rho) of every column of ``left`` with every one of ``right``, over the rows that have both.

    One pass sums the moments of all pairs, which give each pair's line; a second measures the
    largest residual from it. ``exact``: equal up to CLOSE; ``affine``: the line's residual is within
    RESIDUAL of the values' scale (a constant one matches a constant one). Pairs of fewer than two
    shared rows have no row.
    """
    spark = wide.sparkSession
    a, b = len(left), len(right)
    rows = staged(wide.select(*keys, *(F.col(c).cast("double").alias(c) for c in (*left, *right))), "cross-rows")
    values = rows.select(*left, *right)

    def matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)
        y, x = m[:, :a, None], m[:, None, a:]
        return y, x, np.isfinite(y) & np.isfinite(x)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, least, most = np.zeros((3, a, b)), np.full((3, a, b), np.inf), np.full((3, a, b), -np.inf)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                y, x, both = matrices(batch.slice(k, 512))
                sums += np.stack([np.where(both, v, 0.0).sum(axis=0) for v in (np.ones_like(y), x, y)])
                for i, v in enumerate((x, y, np.abs(y))):
                    least[i] = np.minimum(least[i], np.where(both, v, np.inf).min(axis=0, initial=np.inf))
                    most[i] = np.maximum(most[i], np.where(both, v, -np.inf).max(axis=0, initial=-np.inf))
        yield pa.RecordBatch.from_pydict({"sums": [sums.tobytes()], "least": [least.tobytes()], "most": [most.tobytes()]})

    def gathered(d: DataFrame, names: Sequence[str]) -> list[list[np.ndarray]]:
        """Small matrices, one a task."""
        found = d.collect()
        return [[np.frombuffer(r[n], float) for r in found] for n in names]

    sums, least, most = gathered(values.mapInArrow(moments, "sums binary, least binary, most binary"), ("sums", "least", "most"))
    n, sx, sy = np.sum(sums, axis=0).reshape(3, a, b)
    least, most = np.min(least, axis=0).reshape(3, a, b), np.max(most, axis=0).reshape(3, a, b)
    with np.errstate(all="ignore"):
        mx, my = sx / n, sy / n

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((2, a, b))
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                y, x, both = matrices(batch.slice(k, 512))
                dx, dy = np.where(both, x - mx, 0.0), np.where(both, y - my, 0.0)  # centred before multiplying
                own += np.stack([(dx * dx).sum(axis=0), (dx * dy).sum(axis=0)])
        yield pa.RecordBatch.from_pydict({"own": [own.tobytes()]})

    sxx, sxy = np.sum(gathered(values.mapInArrow(products, "own binary"), ("own",))[0], axis=0).reshape(2, a, b)
    with np.errstate(all="ignore"):
        slope = np.where(sxx > 0, sxy / sxx, 0.0)

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worst, apart = np.zeros((a, b)), np.zeros((a, b))
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                y, x, both = matrices(batch.slice(k, 512))
                worst = np.maximum(worst, np.where(both, np.abs(y - (my + slope * (x - mx))), 0.0).max(axis=0, initial=0.0))
                apart = np.maximum(apart, np.where(both, np.abs(x - y) - CLOSE * np.abs(y), -1.0).max(axis=0, initial=-1.0))
        yield pa.RecordBatch.from_pydict({"worst": [worst.tobytes()], "apart": [apart.tobytes()]})

    worst, apart = (np.max(x, axis=0).reshape(a, b) for x in gathered(values.mapInArrow(residuals, "worst binary, apart binary"), ("worst", "apart")))
    flat = least[0] == most[0]
    scale = np.maximum(np.maximum(most[1] - least[1], most[2]), 1.0)
    affine = np.where(flat, most[1] - least[1] <= CLOSE + CLOSE * most[2], worst <= RESIDUAL * scale)
    found = [(f, g, int(n[i, j]), bool(apart[i, j] <= CLOSE), bool(affine[i, j])) for i, f in enumerate(left) for j, g in enumerate(right) if n[i, j] >= 2]
    pairs = spark.createDataFrame(found, "feature string, f0_feature string, pairs long, exact boolean, affine boolean")
    matrix = spearman_matrix(rows, keys, [*left, *right])
    either = matrix.select(F.inline(F.array(*(F.struct(F.col(x).alias("feature"), F.col(y).alias("f0_feature"), "rho") for x, y in (("left_feature", "right_feature"), ("right_feature", "left_feature"))))))
    return pairs.join(either, ["feature", "f0_feature"], "left")


def best_cross_matches(pairs: DataFrame, least: float = 0.98) -> DataFrame:
    """The redundant ones (exact, affine or |rho| >= ``least``), of each feature the best: exact, affine, |rho|, name."""
    redundant = pairs.filter(F.col("exact") | F.col("affine") | F.coalesce(F.abs("rho") >= least, F.lit(False)))
    w = Window.partitionBy("feature").orderBy(F.desc("exact"), F.desc("affine"), F.desc_nulls_last(F.round(F.abs("rho"), 9)), "f0_feature")
    return redundant.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def paired_windows(table: DataFrame, eligibility: DataFrame, control: Sequence[str], added: Sequence[str], steps: int = 24) -> DataFrame:
    """(symbol, decision_time, z, control, candidate) of training decisions: windows of ``steps`` hours as arrays of rows.

    ``candidate`` has the columns of ``control`` and ``added``. A decision counts only where the
    control is eligible and the added features are whole on every step, so both windows stand for
    the same decisions, one to one.
    """
    d = table.join(eligibility, ["symbol", "decision_time"])
    w = Window.partitionBy("symbol").orderBy("decision_time")
    near = w.rowsBetween(-(steps - 1), 0)
    there = F.lit(True)
    for c in added:
        there = there & F.col(c).isNotNull()
    us = micros("decision_time")
    rows = lambda names: F.collect_list(F.array(*(F.col(c) for c in names))).over(near)
    d = d.withColumns({"control": rows(control), "candidate": rows([*control, *added]), "_there": F.sum(there.cast("int")).over(near), "_unbroken": F.coalesce(us - F.lag(us, steps - 1).over(w) == (steps - 1) * HOUR, F.lit(False))})
    d = d.filter(F.col("trains") & F.col("eligible") & F.col("_unbroken") & (F.col("_there") == steps))
    return d.select("symbol", "decision_time", (F.col("y") / F.col("sigma")).alias("z"), "control", "candidate")
