"""Operator 3: exact n-gram Jaccard join with adaptive multi-match prefixes, and its components.

1. Each text becomes the set of its word shingles (64-bit hashes). Texts with equal sets form a
   class; a class is known by a 64-bit hash of its set (two of 10^9 classes collide with a
   chance of 3 %), and everything below works on classes, so copies cost nothing more.
2. A count sketch of fixed size holds about how many classes have each shingle. It only orders
   shingles from rare to frequent, the same way everywhere, so any sketch gives right results.
3. A class is indexed by its prefix of n - ceil(t n) + l rarest shingles. Two classes at least t
   alike share l shingles of such prefixes; with different l, the smaller l. l is chosen for each
   class by estimated cost: a longer prefix meets more postings, but fewer candidates have as
   many shared shingles.
   The place of a shared shingle in either prefix bounds the overlap: what stands before a pair's
   first shared shingle is not shared. Rows and pairs that this bound excludes are never formed.
4. Each class is compared with the most central class of each of its prefix shingles; these
   links give first components. Shingles whose classes lie in one component need no further
   comparison: a large group of near copies is settled by comparisons in proportion to its size.
5. Of all other shingles, every pair of classes from different components that shares enough
   prefix shingles is verified. No link between components can be missed, so the components are
   exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, frugal, spread, staged
from tidemark.llm.word_hashes import mixed, pieces

SKETCH_BITS = 20
CHUNK = 1 << 14
MEMBER_BITS = 1 << 26
#: Numbers of shared prefix shingles to choose from; more of them make longer prefixes, and thus more rows of the token join.
MATCHES = (1, 2)
#: Estimated costs of a row of the token join and of a verification, in postings.
JOIN_COST, VERIFY_COST = 3, 30
#: Parts into which the rows of one label are dealt when they are joined with what belongs to the label.
SALT = 16


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text of a column."""
    weights = np.random.default_rng(words).integers(1, 1 << 63, words, np.uint64) | np.uint64(1)
    for piece in pieces(column):
        h = piece.hashes()
        n = max(0, len(h) - words + 1)
        s = np.zeros(n, np.uint64)
        for i in range(words):
            s += h[i : i + n] * weights[i]
        s = mixed(s, 2)
        for a, b in zip(piece.words[:-1].tolist(), piece.words[1:].tolist()):
            if b - a >= words:
                own = np.sort(s[a : b - words + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif b > a:
                yield np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes(), seed=b - a)], np.uint64)
            else:
                yield np.empty(0, np.uint64)


def set_id(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def least_overlap(n: np.ndarray | int, percent: int):
    """ceil(percent n / 100)."""
    return (percent * n + 99) // 100


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 |x and y| >= percent |x or y| for two sorted sets."""
    both = int(np.isin(x, y, assume_unique=True).sum()) if len(x) < len(y) else int(np.isin(y, x, assume_unique=True).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def inventory(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """Two staged tables of one pass: (doc_id, n, cid) per document, and partial sketches (chunk, counts)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        shift = np.uint64(64 - SKETCH_BITS)
        for batch in batches:
            n, cids = [], []
            for s in shingle_sets(batch.column(1), words):
                cid = set_id(s)
                n.append(len(s))
                cids.append(cid)
                if cid not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(cid)
                    np.add.at(sketch, (s >> shift).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cids, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=names)
        if seen:
            parts = sketch.reshape(-1, CHUNK).astype("<u4")
            k = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(range(k), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)

    names = ["doc_id", "n", "cid", "chunk", "counts"]
    both = staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(work), "doc_id long, n long, cid long, chunk int, counts binary"), "shingle-inventory")
    return both.filter(F.col("chunk").isNull()).select("doc_id", "n", "cid"), both.filter(F.col("chunk").isNotNull()).select("chunk", "counts")


def summed_sketch(parts: DataFrame) -> np.ndarray:
    """The whole sketch (2^SKETCH_BITS counts, whatever the input): chunks are summed as they stream."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(*(c.to_pylist() for c in batch.columns)):
                sums[k] = sums.get(k, 0) + np.frombuffer(counts, "<u4").astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "counts": [s.astype("<i8").tobytes() for s in sums.values()]})

    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in parts.repartition(spread(parts.sparkSession), "chunk").mapInArrow(add, "chunk int, counts binary").toLocalIterator():
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counts"], "<i8")
    return out


def matches_for(counts: np.ndarray, n: int, percent: int) -> int:
    """The number of shared prefix shingles to ask for, by estimated cost; ``counts`` from rare to frequent."""
    least = least_overlap(n, percent)
    total = np.cumsum(counts)
    best, found = None, 1
    for m in MATCHES:
        if m > least:
            break
        postings = float(total[n - least + m - 1])
        cost = JOIN_COST * postings + VERIFY_COST * postings / m
        if best is None or cost < 0.8 * best:
            best, found = cost, m
    return found


def prefixes(docs: DataFrame, words: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """Rows (token, cid, n, matches, central, place) of the prefix shingles of each class.

    A task emits a class once; other tasks may emit it again, which changes nothing below.
    """
    spark = docs.sparkSession
    level = np.minimum(np.round(4 * np.log2(1 + sketch)), 255).astype(np.uint8)
    excess = np.minimum(np.maximum(sketch - int(sketch.mean()), 0), 1 << 30).astype(np.int32)
    shared = spark.sparkContext.broadcast((level, excess))  # 5 * 2^SKETCH_BITS bytes, whatever the input

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, (level, excess) = set(), shared.value
        shift = np.uint64(64 - SKETCH_BITS)

        def emitted(tokens, meta):
            cid, n, m, central, size = (np.array(x, np.int64) for x in zip(*meta))
            return pa.RecordBatch.from_pydict({"token": np.concatenate(tokens).astype(np.int64), "cid": np.repeat(cid, size), "n": np.repeat(n, size).astype(np.int32), "matches": np.repeat(m, size).astype(np.int16), "central": np.repeat(central, size).astype(np.int16), "place": np.concatenate([np.arange(k) for k in size]).astype(np.int32)})

        for batch in batches:
            tokens, meta, rows = [], [], 0
            for s in shingle_sets(batch.column(0), words):
                n = len(s)
                cid = set_id(s)
                if not n or cid in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(cid)
                at = (s >> shift).astype(np.int64)
                q = level[at]
                order = np.argsort(q, kind="stable")  # by level, then by hash: the same in every task
                m = matches_for(excess[at[order]], n, percent)
                own = s[order[: n - least_overlap(n, percent) + m]]
                tokens.append(own)
                meta.append((cid, n, m, int(q.sum()) * 16 // n, len(own)))
                rows += len(own)
                if rows > 100_000:
                    yield emitted(tokens, meta)
                    tokens, meta, rows = [], [], 0
            if tokens:
                yield emitted(tokens, meta)

    return docs.select("text").mapInArrow(frugal(work), "token long, cid long, n int, matches short, central short, place int")


def bounded(room, matches, sizes, percent: int):
    """Whether classes of ``sizes`` together can be alike enough where ``room`` shingles of the smaller side follow a match.

    Of a pair alike enough, each of the first ``matches`` shared shingles has at most
    ``matches - 1`` shared ones before it, so it passes.
    """
    return (100 + percent) * (room.cast("long") + matches - 1) >= percent * sizes.cast("long")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are alike enough; ``classes``: (cid, rep), a document of each.

    The sets of the classes that stand in pairs are made from their representatives and shuffled
    to the pairs. A bitmap of fixed size tells most other documents apart by their ids; where it
    is full it only saves less.
    """
    spark = docs.sparkSession
    position = lambda c: F.pmod(F.xxhash64(c), F.lit(MEMBER_BITS))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes, "cid").select((position("rep") + 1).alias("bit"))
    rows = nodes.groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()  # at most MEMBER_BITS bits
    member = np.zeros(MEMBER_BITS // 8, np.uint8)
    for r in rows:
        member[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(member)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            hit = (bits[at >> 3] >> (at & 7) & 1).astype(bool)
            texts = batch.column(1).filter(pa.array(hit))
            for first in range(0, len(texts), 512):
                found = [s for s in shingle_sets(texts.slice(first, 512), words) if len(s)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["cid", "hashes"])

    own = docs.select(position(F.col("doc_id").cast("long")).alias("bit"), "text").mapInArrow(frugal(sets), "cid long, hashes binary").dropDuplicates(["cid"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            good = [alike(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64), percent) for i in range(batch.num_rows)]
            if any(good):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))

    left, right = own.select(F.col("cid").alias("a"), F.col("hashes").alias("x")), own.select(F.col("cid").alias("b"), F.col("hashes").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def with_label_value(rows: DataFrame, values: DataFrame, node: str) -> DataFrame:
    """``rows`` left-joined with ``values`` (a row a label) by label; the rows of one label are dealt into SALT parts by ``node``.

    Sorted and merged: Spark's estimate of ``values`` leaves out that there are SALT rows of each,
    so it would gather far more in the driver than its limit for a broadcast.
    """
    parts = values.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).hint("merge")
    return rows.withColumn("salt", F.pmod(F.xxhash64(node), F.lit(SALT)).cast("int")).join(parts, ["label", "salt"], "left").drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's component; nodes without an edge are left out.

    Least labels of neighbours, then labels of labels, until nothing changes; each round is staged.
    """
    both = staged(edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*").distinct(), "edges")
    labels = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label"))
    while True:
        labels = staged(labels, "labels")
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        step = staged(step, "near-labels")
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond")).join(step.select("label").distinct(), "label")
        step = staged(with_label_value(step, jump, "node").select("node", "was", F.least("label", F.coalesce("beyond", "label")).alias("label")), "labels")
        labels = step.select("node", "label")
        if step.filter(F.col("was") != F.col("label")).isEmpty():
            return labels


def matchable(rows: DataFrame, percent: int) -> DataFrame:
    """Rows that can be among the first matches with the smallest class of the same shingle."""
    least = F.min("n").over(Window.partitionBy("token"))
    return rows.withColumn("least_n", least).filter(bounded(F.col("n") - F.col("place"), F.col("matches"), F.col("n") + F.col("least_n"), percent)).drop("least_n")


def ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Null or wordless text: the empty set, linked with nothing (its component is itself). Fewer
    words than a shingle: the whole sequence is the one shingle. Repeated rows come back as
    often; further columns are not read; an empty table gives an empty result. A component's id
    is its least doc_id (nulls apart).
    """
    documents, parts = inventory(docs, words)
    sketch = summed_sketch(parts)
    classes = staged(documents.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("rep")), "classes")
    by_token = Window.partitionBy("token")
    several = lambda rows, node: rows.withColumns({"lo": F.min(node).over(by_token), "hi": F.max(node).over(by_token)}).filter(F.col("lo") != F.col("hi")).drop("lo", "hi")
    shared = staged(several(matchable(several(prefixes(docs, words, percent, sketch), "cid"), percent), "cid"), "shared-prefixes")

    room = lambda s: F.col(f"{s}n") - F.col(f"{s}place")
    lead = F.max(F.struct("central", "cid", "n", "place", "matches")).over(by_token)
    first = shared.withColumn("lead", lead).select("cid", "n", "place", "matches", *(F.col(f"lead.{c}").alias(f"lead_{c}") for c in ("cid", "n", "place", "matches")))
    first = first.filter((F.col("cid") != F.col("lead_cid")) & bounded(F.least(room(""), room("lead_")), F.least("matches", "lead_matches"), F.col("n") + F.col("lead_n"), percent)).select(*ordered("cid", "lead_cid"))
    first = staged(first.distinct(), "central-pairs")
    links = staged(verified(first, docs, classes, words, percent), "central-links")
    known = components(links)

    placed = shared.drop("central").distinct().join(known, F.col("cid") == F.col("node"), "left").select("token", "cid", "n", "matches", "place", F.coalesce("label", "cid").alias("label"))
    placed = staged(several(matchable(several(placed, "label"), percent), "label"), "open-prefixes")
    side = lambda s: placed.select("token", *(F.col(c).alias(f"{s}_{c}") for c in ("cid", "n", "matches", "place", "label")))
    sizes, needed = F.col("x_n") + F.col("y_n"), F.least("x_matches", "y_matches")
    met = side("x").join(side("y"), "token").filter((F.col("x_label") < F.col("y_label")) & bounded(F.least(room("x_"), room("y_")), needed, sizes, percent))
    pairs = met.groupBy("x_cid", "y_cid").agg(F.count("*").alias("shared"), F.min(needed).alias("needed"), F.min(sizes).alias("sizes"), F.least(F.max(room("x_")), F.max(room("y_"))).alias("room"))
    rest = pairs.filter((F.col("shared") >= F.col("needed")) & bounded(F.col("room"), F.lit(1), F.col("sizes"), percent)).select(*ordered("x_cid", "y_cid"))
    rest = staged(rest.join(first, ["a", "b"], "left_anti"), "other-pairs")
    if not rest.isEmpty():
        more = staged(verified(rest, docs, classes, words, percent), "other-links")
        if not more.isEmpty():
            known = components(links.unionByName(more))

    grouped = documents.join(known, documents.cid == known.node, "left").select("doc_id", "n", F.coalesce("label", "cid").alias("label"))
    heads = grouped.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("head"), F.count("*").alias("members")).filter("members > 1").drop("members")
    out = with_label_value(grouped, heads, "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("head", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def first_of_each(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """One row of ``docs`` for each component: that of its least doc_id.

    A document is known by its doc_id: of repeated rows with equal texts one stays, and rows that
    share a doc_id but not their text stay or go together. Documents without words stay, each on
    its own, and so do rows without a doc_id. An empty table gives an empty result.
    """
    keep = jaccard_components(docs, words, percent).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    unnamed = docs.filter(F.col("doc_id").isNull())
    (key,) = fresh(docs.columns, "text_key")
    kept = docs.join(keep, "doc_id", "left_semi").withColumn(key, F.xxhash64("text")).dropDuplicates(["doc_id", key]).drop(key)
    return kept.unionByName(unnamed).select(*(F.col(f"`{c}`") for c in docs.columns))
