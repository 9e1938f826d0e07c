"""Operator 13: whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance is never formed. Vectors become integers x = floor(1024 c) + 100000, so n and the sums
S are exact; they are written once as blocks of packed integers, and each product of the covariance
with a few columns Q is one pass over the blocks, X'XQ of the centred rows, summed task by task.

A filter polynomial of V, applied by the three-term recurrence (one pass a degree), damps the part
of the spectrum below the wanted one: on [low, cut] a Chebyshev polynomial stays within 1, above it
grows fast. ``low`` is a lower bound of the spectrum from a few Lanczos passes, ``cut`` the smallest
Ritz value of the block of columns. Then QR and a Rayleigh-Ritz step give new Ritz pairs. A pair
whose residual |Vq - eq| is small enough is locked and projected out of everything after, so a
dominant direction can't drown the others. Steps go on until all wanted pairs are certified by
their residuals; should they stand still before, that is an error, not a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged

COMPONENTS = 8
GUARD = 16  # columns of the block beyond the wanted ones
LANCZOS = 10
MOST_DEGREE = 12
#: A locked pair's residual, as a share of its eigenvalue.
CLOSE = 2e-13
MOST_STEPS = 60
#: Growth of the strongest direction against the weakest in one filter, so that no column loses its digits.
MOST_GROWTH = 1e7
BLOCK_VALUES = 1 << 20
ADDERS = 16
UNIT, SHIFT, LARGEST = 1024, 100_000, 1 << 40


def integers(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of a list column remain, and their x (vectors x dims)."""
    wide = np.asarray(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False), np.int64)
    right = np.flatnonzero(wide == dims)
    flat = column.take(pa.array(right)).flatten() if len(right) < len(column) else column.flatten()
    values = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), float).reshape(len(right), dims)  # null: NaN
    whole = np.isfinite(values).all(axis=1)
    x = np.floor(UNIT * values[whole])
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError(f"an entry beyond {LARGEST // UNIT} in size: exact sums would leave 64 bits")
    return right[whole], x.astype(np.int64) + SHIFT


def dimensions(vectors: DataFrame) -> int:
    """The length that most vectors have; of equally many the greatest. 0 without vectors."""
    usual = vectors.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return usual["dims"] if usual else 0


def blocks_of(vectors: DataFrame, dims: int) -> DataFrame:
    """n, sums (per dimension) and x less SHIFT (packed little-endian integers of 16 bits where they fit, else 64) of blocks of vectors, staged."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = integers(batch.column(0), dims)
            for k in range(0, len(x), max(1, BLOCK_VALUES // dims)):
                own = x[k : k + max(1, BLOCK_VALUES // dims)]
                narrow = own - SHIFT
                small = bool(np.abs(narrow).max() < 1 << 15)
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(own)], pa.int64()), "sums": pa.array([own.sum(axis=0)], pa.list_(pa.int64())), "small": [small], "x": pa.array([narrow.astype("<i2" if small else "<i8").tobytes()], pa.binary())})

    return staged(vectors.select("embedding").mapInArrow(work, "n long, sums array<long>, small boolean, x binary"), "vector-blocks")


@dataclass
class Covariance:
    """V = sum (x - S/n)(x - S/n)' / n as an operator on a few columns; every product is one pass."""

    blocks: DataFrame
    n: int
    sums: np.ndarray  # exact

    def passed(self, columns: np.ndarray, outer: bool = False) -> np.ndarray:
        """V times the columns, or with ``outer`` the columns' own covariance, columns' V columns."""
        n, sums, dims = self.n, self.sums, len(self.sums)
        shape = (columns.shape[1] if outer else dims, columns.shape[1])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for small, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own = centred(np.frombuffer(x, "<i2" if small else "<i8").reshape(-1, dims).astype(np.int64) + SHIFT, n, sums)
                    z = own @ columns
                    total += (z if outer else own).T @ z
            yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [np.frombuffer(p, float) for batch in batches for p in batch.column(0).to_pylist()]
            if parts:
                yield pa.RecordBatch.from_pydict({"part": pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())})

        # a sum a task, added up by a few tasks: the driver sees a bounded number of small matrices
        found = self.blocks.select("small", "x").mapInArrow(work, "part binary").repartition(ADDERS).mapInArrow(add, "part binary").collect()
        return np.sum([np.frombuffer(r["part"], float) for r in found], axis=0).reshape(shape) / n


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n: the difference is taken in integers, so no digits of the mean are lost."""
    if n * (LARGEST + SHIFT) < 1 << 62 or (len(x) and n * int(np.abs(x).max()) + int(np.abs(sums).max()) < 1 << 62):
        return (n * x - sums) / n
    return ((n * x.astype(object) - sums.astype(object)) / n).astype(float)


def fit_list(vectors: DataFrame) -> Covariance:
    dims = dimensions(vectors)
    if not dims:
        return Covariance(vectors, 0, np.zeros(0, np.int64))
    blocks = blocks_of(vectors, dims)
    sums = blocks.select("n", F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("k").collect()
    n = blocks.agg(F.sum("n")).first()[0] or 0
    found = [int(r["s"]) for r in sums]
    return Covariance(blocks, n, np.array(found, np.int64 if all(abs(s) < 1 << 62 for s in found) else object))


@dataclass
class Spectrum:
    values: np.ndarray  # the leading eigenvalues, falling
    vectors: np.ndarray  # unit columns
    trace: float
    residual: float  # the largest |Vq - eq|
    passes: int


def spectrum(v: Covariance, wanted: int = COMPONENTS, guard: int = GUARD, close: float = CLOSE, seed: int = 0) -> Spectrum:
    """The ``wanted`` leading eigenpairs of V, certified by their residuals; fewer where V's rank is lower."""
    dims = len(v.sums)
    wanted = min(wanted, dims)
    passes = 0

    def product(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return v.passed(q)

    rng = np.random.default_rng(seed)
    trace = total_variance(v)
    locked, values, residuals = np.zeros((dims, 0)), [], []

    def apart(y: np.ndarray) -> np.ndarray:
        return y - locked @ (locked.T @ y)

    low = 0.0 if wanted + guard >= dims else lower_bound(product, rng.standard_normal(dims))
    q = np.linalg.qr(rng.standard_normal((dims, min(dims, wanted + guard))))[0]
    ritz, stale, last = None, 0, math.inf
    for _ in range(MOST_STEPS):
        if ritz is not None and q.shape[1] + locked.shape[1] < dims:
            q = filtered(product, apart, q, ritz, low)
        q = np.linalg.qr(apart(np.linalg.qr(apart(q))[0]))[0]
        y = product(q)
        inner = q.T @ y
        ritz, turn = np.linalg.eigh((inner + inner.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        q, y = q @ turn, y @ turn
        off = np.linalg.norm(apart(y - q * ritz), axis=0)  # what is left along locked directions is rounding
        k = 0
        while k < q.shape[1] and len(values) < wanted and off[k] <= close * max(float(ritz[k]), 1e-12 * trace):
            values.append(float(ritz[k]))
            residuals.append(float(off[k]))
            k += 1
        stale = stale + 1 if not k and off[0] > last / 2 else 0
        last = math.inf if k else float(off[0])
        locked, q, ritz = np.hstack([locked, q[:, :k]]), q[:, k:], ritz[k:]
        if len(values) == wanted:
            break
        if stale >= 3:
            close *= 4  # the sums' own rounding is above what was asked for
            if close > 1e-9:
                raise ArithmeticError("the eigenpairs do not settle")
    else:
        raise ArithmeticError(f"{len(values)} of {wanted} eigenpairs certified after {MOST_STEPS} steps")
    order = np.argsort(-np.array(values), kind="stable")
    values, locked = np.array(values)[order], locked[:, order]
    positive = values > 1e-12 * max(trace, 1e-300)
    return Spectrum(values[positive], locked[:, positive], trace, max(residuals), passes)


def filtered(product, apart, q: np.ndarray, ritz: np.ndarray, low: float) -> np.ndarray:
    """The scaled Chebyshev polynomial of V on the columns: within 1 on [low, cut], growing above."""
    cut = float(ritz[-1])
    half, middle = (cut - low) / 2, (cut + low) / 2
    if half <= 1e-14 * max(cut, 1e-300):
        return product(q)
    growth = math.acosh(max(1.0 + 1e-12, (float(ritz[0]) - middle) / half))
    degree = int(min(MOST_DEGREE, max(2, math.log(MOST_GROWTH) / growth)))
    sigma = first = half / (float(ritz[0]) - middle)
    before, now = q, apart(product(q) - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, apart(product(now) - middle * now) * (2 * after / half) - sigma * after * before
        sigma = after
    return now


def lower_bound(product, start: np.ndarray, steps: int = LANCZOS) -> float:
    """A number below the spectrum (with all but certainty): least Ritz value of a short Lanczos run less its last coupling."""
    basis, alpha, beta = [start / np.linalg.norm(start)], [], []
    for _ in range(min(steps, len(start))):
        w = product(basis[-1][:, None])[:, 0]
        alpha.append(float(basis[-1] @ w))
        for b in (*basis, *basis):  # orthogonal to all before, twice
            w = w - (b @ w) * b
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * abs(alpha[0]):
            break
        basis.append(w / beta[-1])
    k = len(alpha)
    t = np.diag(alpha) + np.diag(beta[: k - 1], 1) + np.diag(beta[: k - 1], -1)
    return max(0.0, float(np.linalg.eigvalsh(t)[0]) - beta[-1])


def total_variance(v: Covariance) -> float:
    """trace(V), one pass of centred squares."""
    n, sums, dims = v.n, v.sums, len(v.sums)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            for small, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = centred(np.frombuffer(x, "<i2" if small else "<i8").reshape(-1, dims).astype(np.int64) + SHIFT, n, sums)
                total += float(np.einsum("ij,ij->", own, own))
        yield pa.RecordBatch.from_pydict({"t": [total]})

    return (v.blocks.select("small", "x").mapInArrow(work, "t double").agg(F.sum("t")).first()[0] or 0.0) / n


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """sum over dimensions of (n x - S)^2, exact; None where it does not fit into 64 bits."""
    if not len(x):
        return []
    most = n * int(np.abs(x).max()) + int(np.abs(sums).max())
    if most < 1 << 62:
        own = n * x - sums
        if int(np.abs(own).max()) ** 2 * own.shape[1] < 1 << 63:
            return (own * own).sum(axis=1).tolist()
    own = n * x.astype(object) - sums.astype(object)
    return [d if d < 1 << 63 else None for d in (own * own).sum(axis=1).tolist()]


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row a remaining vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, hold null or non-finite entries, or have another length than most do
    (ties: the longest), are dropped; so are empty ones. Where the covariance has a lower rank than
    ``components``, only its positive eigenvalues have rows; equal vectors alone (or a single one)
    give none, as does an empty table. Repeated rows and vec_ids count and return each, a null
    vec_id stays null. ``deviation`` is null where the exact number exceeds 64 bits. Further columns
    are not read.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    v = fit_list(own)
    if not v.n:
        return spark.createDataFrame([], OUT)
    found = spectrum(v, components)
    if not len(found.values):
        return spark.createDataFrame([], OUT)
    scaled = found.vectors / np.sqrt(found.values)
    error = float(np.abs(v.passed(scaled, outer=True) - np.eye(len(found.values))).max())
    n, sums, explained = v.n, v.sums, found.values / found.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(explained)
        for batch in batches:
            rows, x = integers(batch.column(1), len(sums))
            ids = batch.column(0).take(pa.array(rows).take(pa.array(np.repeat(np.arange(len(rows)), k))))
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": ids,
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    "n": pa.array(np.full(len(rows) * k, n)),
                    "deviation": pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k))),
                    "whitened": (centred(x, n, sums) @ scaled).ravel(),
                    "explained": np.tile(explained, len(rows)),
                    "identity_error": np.full(len(rows) * k, error),
                }
            )

    return own.mapInArrow(project, OUT)
