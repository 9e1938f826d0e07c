"""Operator 4: best-fit packing by linear grouping.

Sequences hold at most ``capacity`` tokens. A longer document is cut from its end into full
pieces, so only its first piece can be shorter; full pieces fill sequences of their own. The
other pieces have fewer than ``capacity`` different lengths, so the packing is decided on their
histogram (its size depends on the capacity alone):

1. linear grouping: the large pieces, from long to short, fall into groups of equal number, and
   each is rounded up to its group's longest;
2. the linear programme over configurations of the few rounded sizes is solved by column
   generation (an integer knapsack prices new configurations) and rounded down;
3. actual pieces, at their actual lengths, take the places of their group's size. A sequence so
   laid out stays if its free room is next to nothing or great enough for small pieces, and is
   opened again if rounding left a gap between the two. Where "next to nothing" ends and "enough"
   begins is chosen among a few bounds: the pair that ends in the fewest sequences, of such pairs
   the one that keeps most pieces where the programme put them;
4. what is left over, and all small pieces, go by best fit, longest first, into the tightest
   sequences that still have room.

Runs of equal sequences are handled as one, so the decision is a short table of (length, ranks,
sequences, offset) that is broadcast; every piece finds its place by its rank among the pieces
of its length. Ranks come from counts per task and their prefix sums: no length is sorted or
gathered in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import frugal, staged
from tidemark.llm.encoding import encoder_for
from tidemark.llm.token_output import ENCODED_CHARS, text_batches

GROUPS = 64
#: Pieces of more than this part of the capacity are grouped; the rest are small.
LARGE = 3
#: Bounds tried for the free tokens of a laid-out sequence that count as none, and as room for small pieces.
NONE = (0, 2, 4, 8, 16)
ROOM = (16, 24, 32, 48, 64, 96, 128, 192, 256, 1 << 30)


@dataclass
class Run:
    """``count`` sequences of equal content: (length, how many of it) in order; ``configured``: laid out by the programme."""

    count: int
    content: list[tuple[int, int]] = field(default_factory=list)
    configured: bool = False

    def used(self) -> int:
        return sum(length * k for length, k in self.content)


def linear_groups(counts: np.ndarray, least: int, groups: int) -> list[list[tuple[int, int]]]:
    """Pieces of at least ``least`` tokens, longest first, in groups of equal number: lists of (length, count)."""
    total = int(counts[least:].sum())
    out: list[list[tuple[int, int]]] = [[]]
    share = -(-total // groups) if total else 1
    room = share
    for length in range(len(counts) - 1, least - 1, -1):
        left = int(counts[length])
        while left:
            take = min(left, room)
            out[-1].append((length, take))
            left, room = left - take, room - take
            if not room:
                out.append([])
                room = share
    return [g for g in out if g]


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often to use them: the linear programme's basic solution, by column generation."""
    k = len(sizes)
    size, need = np.array(sizes), np.array(demand, float)
    columns = np.diag(capacity // size).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        value, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(size.min()), capacity + 1):
            fits = np.flatnonzero(size <= c)
            gains = value[c - size[fits]] + prices[fits]
            g = int(gains.argmax())
            value[c], pick[c] = gains[g], fits[g]
            if value[c - 1] >= value[c]:
                value[c], pick[c] = value[c - 1], -2
        if value[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c > 0 and pick[c] != -1:
            if pick[c] == -2:
                c -= 1
            else:
                column[pick[c]] += 1
                c -= int(size[pick[c]])
        direction, amounts = inverse @ column, inverse @ need
        good = direction > 1e-9
        if not good.any():
            break
        ratios = np.where(good, amounts / np.where(good, direction, 1), np.inf)
        row = int(ratios.argmin())
        columns[:, row] = column
        inverse[row] /= direction[row]
        direction[row] = 0.0
        inverse -= np.outer(direction, inverse[row])
    amounts = inverse @ need
    return [(columns[:, j].astype(int), float(amounts[j])) for j in range(k) if amounts[j] > 1e-9]


def _split_run(run: Run, queue: list[list[int]], runs: list[Run]) -> None:
    """Give each sequence of ``run`` one piece from the group's queue, splitting it where the length changes."""
    left = run.count
    while left:
        own = queue[0]
        take = min(left, own[1])
        runs.append(Run(take, [*run.content, (own[0], 1)], run.configured))
        own[1] -= take
        left -= take
        if not own[1]:
            queue.pop(0)


def configured(counts: np.ndarray, capacity: int, groups: int) -> tuple[list[Run], np.ndarray]:
    """Sequences laid out by the linear programme over the large pieces, and the counts of the pieces not in them."""
    left = counts.copy()
    least = capacity // LARGE + 1
    grouped = linear_groups(counts, least, groups)
    made: list[Run] = []
    if not grouped:
        return made, left
    queues = [[list(x) for x in g] for g in grouped]
    for column, amount in configurations([g[0][0] for g in grouped], [sum(n for _, n in g) for g in grouped], capacity):
        have = min((sum(n for _, n in queues[g]) // int(column[g]) for g in np.flatnonzero(column)), default=0)
        times = min(int(amount + 1e-9), have)
        open_runs = [Run(times, configured=True)] if times else []
        for g in np.flatnonzero(column):
            for _ in range(int(column[g])):
                following: list[Run] = []
                for run in open_runs:
                    _split_run(run, queues[g], following)
                open_runs = following
        made += open_runs
    for run in made:
        for length, each in run.content:
            left[length] -= run.count * each
    return made, left


def best_fit(counts: np.ndarray, runs: list[Run], capacity: int) -> list[Run]:
    """``runs`` with the pieces of ``counts`` added, longest first, each into the tightest sequence with room, else a new one."""
    by_room: list[list[Run]] = [[] for _ in range(capacity + 1)]
    for run in runs:
        by_room[capacity - run.used()].append(run)
    for length in range(capacity - 1, 0, -1):
        left = int(counts[length])
        room = length
        while left and room <= capacity:
            if not by_room[room]:
                room += 1
                continue
            run = by_room[room].pop()
            each = room // length
            whole = min(run.count, left // each)
            if whole:
                by_room[room - each * length].append(Run(whole, [*run.content, (length, each)], run.configured))
                left -= whole * each
                if run.count > whole:
                    by_room[room].append(Run(run.count - whole, run.content, run.configured))
            else:
                by_room[room - left * length].append(Run(1, [*run.content, (length, left)], run.configured))
                if run.count > 1:
                    by_room[room].append(Run(run.count - 1, run.content, run.configured))
                left = 0
        if left:
            each = capacity // length
            if left // each:
                by_room[capacity - each * length].append(Run(left // each, [(length, each)]))
            if left % each:
                by_room[capacity - (left % each) * length].append(Run(1, [(length, left % each)]))
    return [r for own in by_room for r in own]


def plan(counts: np.ndarray, capacity: int, groups: int = GROUPS) -> list[Run]:
    """Runs of sequences that hold all pieces; ``counts[l]`` pieces of length l < capacity."""
    counts = counts.astype(np.int64)
    made, left = configured(counts, capacity, groups)
    best = None
    for none in NONE:
        for room in ROOM:
            kept = [r for r in made if not none < capacity - r.used() < room]
            again = left.copy()
            for run in made:
                if none < capacity - run.used() < room:
                    for length, each in run.content:
                        again[length] += run.count * each
            runs = best_fit(again, kept, capacity)
            value = sum(r.count for r in runs), -sum(r.count * each for r in kept for _, each in r.content)
            if best is None or value < best[0]:
                best = value, runs
    return best[1]


def places(counts: np.ndarray, capacity: int, groups: int = GROUPS) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces of it a sequence, offset of the first)."""
    out, used, first = [], np.zeros(capacity + 1, np.int64), 0
    for run in plan(counts[:capacity], capacity, groups):
        offset = 0
        for length, each in run.content:
            start = int(used[length])
            used[length] += run.count * each
            out.append((length, start, int(used[length]), first, each, offset))
            offset += length * each
        first += run.count
    out.append((capacity, 0, int(counts[capacity]), first, 1, 0))
    return out


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with its task and its rank there among its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, ranks = encoder_for(tokenizer_path, end_id), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for ids, texts in text_batches(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ENCODED_CHARS):
                rows = []
                for doc_id, data in zip(ids, encoder.encode(texts)):
                    tokens = np.frombuffer(data, encoder.dtype).astype("<u4")
                    first = len(tokens) % capacity or capacity
                    start, end = 0, first
                    while start < len(tokens):
                        rows.append((doc_id, rows[-1][1] + 1 if start else 0, start, end - start, zlib.crc32(tokens[start:end]), int(ranks[end - start])))
                        ranks[end - start] += 1
                        start, end = end, end + capacity
                doc_id, piece, start, length, crc, rank = zip(*rows)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_id, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "task": pa.array([task] * len(rows), pa.int32()), "local_rank": pa.array(rank, pa.int64())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(cut), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local_rank long")


def packed(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, groups: int = GROUPS) -> DataFrame:
    """Every piece with its sequence_id and offset.

    Null text: empty, a piece of the end id alone. Repeated rows are packed each. Further columns
    are not read. An empty table gives an empty result.
    """
    cut = staged(pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    spark = docs.sparkSession
    counted = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row a length
        histogram[r["length"]] = r["n"]
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    fields = ("length", "first", "end", "sequence", "each", "at")
    runs = np.array(places(histogram, capacity, groups), np.int64)
    table = spark.createDataFrame(pa.table({f: runs[:, i].copy() for i, f in enumerate(fields)}))  # as Arrow: no Python workers for rows
    ranked = cut.join(bases, ["task", "length"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    placed = ranked.join(F.broadcast(table), "length").filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    k = F.col("rank") - F.col("first")
    sequence = F.col("sequence") + F.floor(k / F.col("each")).cast("long")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), (F.col("at") + k % F.col("each") * F.col("length")).alias("offset"))
