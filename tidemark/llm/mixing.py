"""Operator 7: mixing to target weights by soft membership.

Domains come from the labelled table: toxic, poor, good. A softmax regression over hashed text,
fitted on a bounded sample of labelled rows, gives every document posteriors p_d over the
domains, kept to a thousandth. Rates 0 <= r_d <= most (how often a document is taken) then solve

    minimise  sum_k (m_k - w_k)^2 / (2 mass_k)  +  mu/2 sum_d s_d (r_d - 1)^2

where s_d is the document's share of all tokens, m_k = sum_d r_d s_d p_dk the expected share of
domain k, w_k its target share of the token budget and mass_k its share at rate 1. Projected
gradient steps (accelerated, begun anew every few steps) are taken by all documents at once: a
step needs only the domain totals before it, so each is one distributed sum of a few numbers.
Documents of equal posteriors have equal rates at every step, so the sums run over a table of
distinct posteriors with their tokens; a thousandth's grid has at most 501,501 of them, whatever
the number of documents. Steps end when they change neither rates nor totals any more; if the
bound on their number comes first, the result says so.

Tokens are words (runs of characters without white space).
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import fresh, frugal, staged
from tidemark.llm.ordinal import BITS, features_of, grade, sampled

DOMAINS = ("toxic", "poor", "good")
TARGETS = {"toxic": 0.02, "poor": 0.08, "good": 0.90}
PER_DOMAIN = 4096
MU = 1e-4
GRID = 1000  # posteriors are multiples of its inverse
RESTART = 20


def fit_softmax(rows: list[tuple[int, np.ndarray]], stands: dict[int, float], bits: int = BITS, epochs: int = 4, l1: float = 0.3, alpha: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x domains) and biases, by FTRL; ``stands``: labelled rows that a row of each domain stands for."""
    k = len(DOMAINS)
    z, n = np.zeros((1 << bits, k)), np.zeros((1 << bits, k))
    share = np.array([sum(stands[g] for g, _ in rows if g == c) for c in range(k)], float)
    bias = np.log(np.maximum(share / (share.sum() or 1.0), 1e-13))  # a domain without rows has no mass
    mean = sum(stands[g] for g, _ in rows) / max(1, len(rows)) or 1.0
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            g, x = rows[i]
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) > l1, -(zx - np.sign(zx) * l1) / ((0.1 + np.sqrt(nx)) / alpha), 0.0)
            slope = softmax((w.sum(axis=0) + bias)[None, :])[0]
            slope[g] -= 1
            slope *= min(4.0, max(0.25, stands[g] / mean))
            z[x] += slope - (np.sqrt(nx + slope * slope) - np.sqrt(nx)) / alpha * w
            n[x] += slope * slope
    return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((0.1 + np.sqrt(n)) / alpha), 0.0), bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame, labels: DataFrame, targets: dict[str, float], per_domain: int = PER_DOMAIN) -> tuple[tuple[np.ndarray, np.ndarray], dict[str, float]]:
    """Fit on a bounded sample of the labelled rows among ``docs``; only their hashed features reach the driver.

    Returns the model and the targets; without labelled rows no target can be aimed at.
    """
    rows, stands = sampled(docs, grade(labels), per_domain)
    return fit_softmax(rows, stands), targets if rows else {}


def memberships(column: pa.Array, model: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text of a column, and its posteriors as whole numbers that add up to GRID."""
    weights, bias = model
    found = [(n, weights[f].sum(axis=0)) for n, f in features_of(column)]
    tokens = np.array([n for n, _ in found], np.int64)
    p = softmax(np.array([w for _, w in found]).reshape(-1, len(bias)) + bias)
    q = np.rint(p * GRID).astype(np.int32)
    q[np.arange(len(q)), p.argmax(axis=1)] += GRID - q.sum(axis=1, dtype=np.int32)
    return tokens, q


def with_memberships(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], names: list[str]) -> DataFrame:
    """``docs`` with its tokens and its posteriors (of GRID) in columns of these names, staged: texts are hashed once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, q = memberships(batch.column(text), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens), *(pa.array(q[:, k]) for k in range(q.shape[1]))], names=[*batch.schema.names, *names])

    schema = StructType(list(docs.schema.fields))
    for name, kind in zip(names, ("long", *["integer"] * len(DOMAINS))):
        schema = schema.add(name, kind)
    return staged(docs.mapInArrow(frugal(work), schema), "memberships")


@dataclass
class Solution:
    """Steps of the solver, by which any posterior's rate follows, and how far they came."""

    pulls: list[np.ndarray]  # each step's scaled residual of the domain totals
    most: float
    goal: np.ndarray  # wanted and reached shares of all tokens
    reached: np.ndarray
    converged: bool


def rates_of(p: np.ndarray, pulls: list[np.ndarray], mu: float, most: float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rates after the steps so far, where the next step begins, and the rates before the last step."""
    before = now = ahead = np.ones(len(p))
    for step, pull in enumerate(pulls):
        before, now = now, np.clip(ahead - (p @ pull + mu * (ahead - 1)) / (1 + mu), 0.0, most)
        k = step % RESTART
        ahead = now + k / (k + 3) * (now - before)
    return now, ahead, before


def solve(cells: DataFrame, targets: dict[str, float], most: float = np.inf, budget: float | None = 1.0, mu: float = MU, steps: int = 400, close: float = 1e-4) -> Solution:
    """Projected gradient over ``cells`` (tokens and one posterior column per domain).

    ``budget``: wanted tokens as a share of all; None: as many as use up, at rate ``most``, the
    domain of the greatest target, so that scarcity of another domain costs it nothing. A domain without any mass cannot be matched; it is left out and the other targets
    are scaled to their sum. Ends when a step changes the totals by less than ``close`` and the
    rates by less than ten times that (root mean square over tokens).
    """
    fields = [f"{w}_{d}" for w in ("now", "ahead") for d in DOMAINS] + ["change", "all"]

    def sums(pulls: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float, float]:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(len(fields))
            for batch in batches:
                t, *q = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                p = np.stack(q, axis=1) / GRID
                now, ahead, before = rates_of(p, pulls, mu, most)
                out += np.concatenate([(now * t) @ p, (ahead * t) @ p, [t @ (now - before) ** 2, t.sum()]])
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], names=fields)

        row = cells.mapInArrow(partial, ", ".join(f"{f} double" for f in fields)).agg(*(F.sum(f).alias(f) for f in fields)).first()
        found = np.array([row[f] or 0.0 for f in fields])
        k = len(DOMAINS)
        return found[:k], found[k : 2 * k], found[-2], found[-1]

    mass, _, _, total = sums([])
    if not total:
        return Solution([], most, mass, mass, True)
    mass = mass / total
    have = mass > 1e-9
    goal = np.where(have, [targets.get(d, 0.0) for d in DOMAINS], 0.0)
    goal = goal / goal.sum() if goal.sum() else mass
    if budget is None:
        main = int(goal.argmax())
        budget = float(most * mass[main] / goal[main])
    goal = goal * budget
    pulls: list[np.ndarray] = []
    now = ahead = mass
    while len(pulls) < steps:
        pulls.append(np.where(have, (ahead - goal) / np.maximum(mass, 1e-9), 0.0))
        was = now
        now, ahead, change, _ = sums(pulls)
        now, ahead = now / total, ahead / total
        if np.abs(now - was).max() <= close and np.sqrt(change / total) <= 10 * close:
            return Solution(pulls, most, goal, now, True)
    warnings.warn(f"mixing did not converge in {steps} steps: wanted {goal}, reached {now}", RuntimeWarning, stacklevel=2)
    return Solution(pulls, most, goal, now, False)


def with_rates(members: DataFrame, names: list[str], rate: str, targets: dict[str, float], most: float, budget: float | None) -> tuple[DataFrame, Solution]:
    """``members`` with the column ``rate``, and the solution it comes from."""
    tokens, *own = names
    cells = staged(members.groupBy(*own).agg(F.sum(tokens).alias(tokens)).select(tokens, *own), "posterior-cells")
    found = solve(cells, targets, most, budget)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) / GRID
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates_of(p, found.pulls, MU, found.most)[0])], names=[*own, rate])

    rates = cells.select(*own).mapInArrow(rated, ", ".join(f"`{c}` int" for c in own) + f", `{rate}` double")
    return members.join(F.broadcast(rates), own), found  # at most 501,501 rows, whatever the input


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, per_domain: int = PER_DOMAIN) -> DataFrame:
    """doc_id, tokens, posteriors and rate of every document, and whether the solver converged.

    Null and empty texts have no tokens and get a rate by their posterior; repeated rows are
    rated each; further columns are not read; an empty table gives an empty result. Without
    labels the posteriors are equal and every rate is 1.
    """
    names = ["tokens", *DOMAINS]
    model, targets = train(docs, labels, targets, per_domain)
    members = with_memberships(docs.select(F.col("doc_id").cast("long"), "text"), model, names)
    rated, found = with_rates(members.drop("text"), names, "rate", targets, np.inf, 1.0)
    return rated.select("doc_id", "tokens", *((F.col(d) / GRID).alias(d) for d in DOMAINS), "rate", F.lit(found.converged).alias("converged"))


def mixed_stage(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, per_domain: int = PER_DOMAIN, most: float = 1.0) -> DataFrame:
    """The documents taken at their rates, with the columns they came with.

    The whole part of a rate is always taken, the rest by a hash of doc_id (of the text where it
    is null), so repeated rows share their lot. With ``most`` 1, nothing is taken twice and the
    token budget is what the domain of the greatest target fills. Null and empty texts are drawn
    by the posterior of emptiness; an empty table gives an empty result; without labels all
    posteriors are equal and every row stays.
    """
    names = fresh(docs.columns, "tokens", *DOMAINS, "rate", "copies")
    rate, copies = names[-2:]
    model, targets = train(docs, labels, targets, per_domain)
    rated, _ = with_rates(with_memberships(docs, model, names[:-2]), names[:-2], rate, targets, most, None if np.isfinite(most) else 1.0)
    chance = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text"))), F.lit(1 << 40)) / float(1 << 40)
    whole = [F.col(f"`{c}`") for c in docs.columns]
    times = F.floor(F.round(F.col(rate), 3) + 1 - chance).cast("int")
    taken = rated.withColumn(copies, times).filter(F.col(copies) > 0)
    if most > 1:
        taken = taken.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return taken.select(*whole)
