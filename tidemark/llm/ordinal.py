"""Operator 6: ordinal cumulative-link regression on graded ratings.

Grades 0 < 1 < 2 come from the labels: toxic, poor, good. One weight vector over hashed text
features is shared by all grades and ordered thresholds cut its score:
P(grade <= j) = sigmoid(threshold_j - w x). The fit is FTRL (absolute penalty, so that words met
by chance get no weight) on a bounded sample of labelled rows; every document then gets its
expected grade and the tail probability P(grade = 2) by which it is selected.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import labelled, staged
from tidemark.llm.word_hashes import MARKS, pieces

BITS = 18
PER_GRADE = 4096
#: Bound of the sample of one grade in features (its rows end before it), so that what is collected has a bounded size.
MOST_FEATURES = 4_000_000
EPOCHS = 4
PREFIX = 5


def grade(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the rows that have both labels; of repeated rows the lowest."""
    g = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & F.col("quality").isNotNull())
    return rows.groupBy("doc_id").agg(F.min(g).alias("grade"))


@functools.cache  # names are few
def other_feature(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) & ((1 << BITS) - 1)


def features_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Words and distinct hashed features of each text of a column.

    Features are its words (without case), their first bytes, marks in words, words in capitals,
    and steps of its length, of how much words and lines repeat, and of how often marks stand in it.
    """
    mask, all_marks = np.uint64((1 << BITS) - 1), (1 << len(MARKS)) - 1
    mark_features = np.array([[other_feature(f"mark{chr(m)}{k}") for k in range(10)] for m in MARKS])
    empty, capitals = np.array([other_feature("empty")], np.int64), other_feature("capitals")
    for piece in pieces(column):
        h = piece.hashes()
        word, first, flags = (h & mask).astype(np.int64), (piece.beginnings(PREFIX) & mask).astype(np.int64), piece.flags()
        shape = flags & np.uint16(all_marks)
        upper = (flags >> 14 == 2) & (piece.ends - piece.starts > 2)
        marks = piece.marks()
        lines, first_line = piece.lines()
        for i, (a, b) in enumerate(zip(piece.words[:-1].tolist(), piece.words[1:].tolist())):
            n = b - a
            if not n:
                yield 0, empty
                continue
            own = np.sort(h[a:b])
            new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            top = int(np.diff(new, append=n).max())
            c, d = first_line[i], first_line[i + 1]
            different = len(set(lines[c:d].tolist()))
            extra = [other_feature(f"top{10 * top // n}"), other_feature(f"variety{10 * len(new) // n}"), other_feature(f"length{n.bit_length() - 1}"), other_feature(f"lines{10 * different // (d - c)}")]
            if upper[a:b].any():
                extra.append(capitals)
            extra += [other_feature(f"s{x}") for x in set(shape[a:b].tolist()) if x]
            often = mark_features[np.arange(len(MARKS)), np.minimum(9, 10 * marks[i] // n)]
            yield n, np.unique(np.concatenate([word[a:b], first[a:b], often, extra]))


def fit(rows: list[tuple[int, np.ndarray]], stands: dict[int, float], bits: int = BITS, epochs: int = EPOCHS, l1: float = 0.3, alpha: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and the two thresholds. ``stands``: how many labelled rows a row of each grade stands for."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    total = sum(stands[g] for g, _ in rows) or 1.0
    cut = np.array([-1.0, 0.0])
    for g in (0, 1):
        share = min(max(sum(stands[x] for x, _ in rows if x <= g) / total, 1e-3), 1 - 1e-3)
        cut[g] = math.log(share / (1 - share))
    cut[1] = max(cut[1], cut[0] + 0.1)
    mean = total / max(1, len(rows))
    order = np.random.default_rng(0)
    step = np.zeros(2)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            g, x = rows[i]
            weight = min(4.0, max(0.25, stands[g] / mean))
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) > l1, -(zx - np.sign(zx) * l1) / ((0.1 + np.sqrt(nx)) / alpha), 0.0)
            score = float(w.sum())
            below = 1 / (1 + np.exp(-np.clip(cut - score, -30, 30)))
            density = below * (1 - below)
            p = np.diff(np.concatenate([[0.0], below, [1.0]]))[g] + 1e-12
            low, high = (density[g - 1] if g else 0.0), (density[g] if g < 2 else 0.0)
            slope = weight * (high - low) / p  # of the loss in the score
            z[x] += slope - (np.sqrt(nx + slope * slope) - np.sqrt(nx)) / alpha * w
            n[x] += slope * slope
            change = np.zeros(2)
            if g < 2:
                change[g] -= weight * high / p
            if g:
                change[g - 1] += weight * low / p
            step += change * change
            cut -= 0.05 * change / (1 + np.sqrt(step))
            cut[1] = max(cut[1], cut[0] + 1e-3)
    w = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((0.1 + np.sqrt(n)) / alpha), 0.0)
    return w, cut


def sampled(docs: DataFrame, graded: DataFrame, per_grade: int, most_features: int = MOST_FEATURES) -> tuple[list[tuple[int, np.ndarray]], dict[int, float]]:
    """Hashed features of a bounded sample of the graded rows among ``docs``, and how many rows one of each grade stands for.

    At most ``per_grade`` rows of each grade, those of least hash of doc_id, and of these as many
    as have ``most_features`` features together. The chosen label rows are bounded, so they are
    broadcast; of repeated documents the first by features counts.
    """
    graded = labelled(graded, docs)
    size = {r["grade"]: r["count"] for r in graded.groupBy("grade").count().collect()}
    chosen = None
    for g in range(3):
        own = graded.filter(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade)
        chosen = own if chosen is None else chosen.unionByName(own)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f.astype("<i4").tobytes() for _, f in features_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "grade", "features"])

    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("grade").cast("int").alias("grade"), "text")
    found = staged(joined.mapInArrow(features, "doc_id long, grade int, features binary").groupBy("doc_id").agg(F.first("grade").alias("grade"), F.min("features").alias("features")), "sample-features")
    order = Window.partitionBy("grade").orderBy(F.xxhash64("doc_id"), "doc_id")
    bounded = found.withColumn("so_far", F.sum(F.octet_length("features") / 4).over(order)).filter(F.col("so_far") <= most_features)
    rows = [(r["grade"], np.frombuffer(r["features"], "<i4").astype(np.int64)) for r in bounded.orderBy("doc_id").select("grade", "features").collect()]
    number = Counter(g for g, _ in rows)
    return rows, {g: size.get(g, 0) / max(1, number[g]) for g in range(3)}


def train(docs: DataFrame, labels: DataFrame, per_grade: int = PER_GRADE, keep: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Fit on a bounded sample of labelled rows; ``keep`` restricts the label rows (to hold some out)."""
    rows = grade(labels)
    return fit(*sampled(docs, rows.filter(keep) if keep is not None else rows, per_grade))


def graded(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade (0 to 2), tail_probability (of grade 2) and kept (at least ``least``).

    Null and empty texts are graded by the feature of emptiness. Repeated rows are graded each;
    further columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cut = shared.value
        for batch in batches:
            score = np.array([weights[f].sum() for _, f in features_of(batch.column(1))])
            above = 1 / (1 + np.exp(np.clip(cut[None, :] - score[:, None], -30, 30)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "expected_grade": above.sum(axis=1), "tail_probability": above[:, 1], "kept": above[:, 1] >= least})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, expected_grade double, tail_probability double, kept boolean")


def ordinal_quality(docs: DataFrame, labels: DataFrame, per_grade: int = PER_GRADE) -> DataFrame:
    """As ``graded``, by a model of the labels; without labels every document gets the thresholds' own shares."""
    return graded(docs, train(docs, labels, per_grade))
