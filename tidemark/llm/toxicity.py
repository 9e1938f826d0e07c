"""Operator 9: toxicity by the nearest labelled examples under exact TF-IDF cosine.

Fitting uses a bounded sample of the labelled training rows (at most ``per_class`` of each label,
those of least hash of doc_id). Terms are words, and words met at least two, three or four times;
every example is indexed under all terms of its text, so each document is compared with its nearest
examples. A term weighs its inverse document frequency, more where
the sample associates it with label 1 beyond chance (likelihood ratio, corrected for the number of
terms tried); there a term counts once for each pair of neighbouring words, so that a copied
passage is no evidence by its copies. The examples form an inverted index in blocks of alike ones:
each term keeps its greatest weight in each block, and the sum over a text's terms bounds its
similarity to any example there. A text is compared with the blocks of greatest bound first; a block
whose bound is below the k-th best similarity so far is skipped, which loses no neighbour. Texts are
taken in batches: within a block, the terms of many examples by a matrix product in single precision,
the others by their postings; for every example within the rounding error of the k-th best the
product is taken again in double precision, which makes the neighbours exact. A document's score is the similarity-weighted
vote of its k nearest examples, calibrated by isotonic regression on the examples' own
leave-one-out votes (taken in tasks); the neighbours' ids are returned as evidence. The index is built in a task,
since its sample is bounded, and written to the shared folder; workers map its files into memory where
the folder is local, so that neither the driver nor each worker holds a copy.
"""

from __future__ import annotations

import io
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import frugal, labelled, new_folder, open_fs, spread, staged, worker_memo
from tidemark.llm.word_hashes import mixed, pieces

PER_CLASS = 4096
NEIGHBOURS = 15
BLOCK = 64
FIRST_BLOCKS = 4  # compared before any is skipped
CLUSTERS = 24
#: Bound of the sample of one label in characters of its texts (its rows end before it).
MOST_CHARS = 32_000_000
LEAN = 8.0  # how much an association with label 1 adds to a term's weight
BATCH = 256
COMMON = 0.1  # terms of a greater share of the examples are compared by matrix product
LEVELS = (2, 3, 4)


def remainder(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; 0 marks held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def level_term(term: np.ndarray, k: int) -> np.ndarray:
    """The term "met at least k times" of a word's term."""
    return mixed(term, 10 + k)


def terms_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Terms (64-bit hashes) of each text of a column and how often each is met (a level: once)."""
    for piece in pieces(column):
        h, left = piece.bare()
        for a, b in zip(piece.words[:-1].tolist(), piece.words[1:].tolist()):
            met, n = np.unique(h[a:b][left[a:b]], return_counts=True)
            found = [met, *(level_term(met[n >= k], k) for k in LEVELS)]
            terms = np.concatenate(found)
            yield terms, np.concatenate([n, np.ones(len(terms) - len(met), n.dtype)])


class Numbers:
    """Numbers of known 64-bit hashes: an open hash table in two arrays."""

    def __init__(self, hashes: np.ndarray, slots: np.ndarray | None = None):
        self.hashes, self.shift = hashes, 64 - max(4, int(2 * len(hashes)).bit_length())
        if slots is not None:
            self.slots = slots
            return
        self.slots = np.full(1 << (64 - self.shift), -1, np.int32)
        left = np.arange(len(hashes), dtype=np.int32)
        at = self._slot(hashes)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) % len(self.slots)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(self.shift)).astype(np.int64)

    def of(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash; -1 for unknown ones."""
        out, left, at = np.full(len(h), -1, np.int32), np.arange(len(h)), self._slot(h)
        if not len(self.hashes):
            return out
        while len(left):
            found = self.slots[at]
            hit = (found >= 0) & (self.hashes[found] == h[left])
            out[left[hit]] = found[hit]
            on = (found >= 0) & ~hit
            left, at = left[on], (at[on] + 1) % len(self.slots)
        return out


@dataclass
class Index:
    """Examples and their inverted lists; size bounded by the sample and its texts."""

    vocabulary: np.ndarray  # terms (64-bit hashes), ascending
    idf: np.ndarray  # weight of each term
    ids: np.ndarray  # doc_id of each example
    label: np.ndarray
    weight: np.ndarray  # how many training rows an example stands for
    starts: np.ndarray  # term -> its postings
    examples: np.ndarray  # postings: example numbers, ascending within a term
    values: np.ndarray  # and normalised weights
    block_starts: np.ndarray | None = None  # term -> its blocks
    blocks: np.ndarray | None = None
    block_max: np.ndarray | None = None
    block_first: np.ndarray | None = None  # block of a term -> its first posting, and the end
    compared: int = 0  # blocks compared and skipped so far
    skipped: int = 0
    product: tuple | None = None
    common: np.ndarray | None = None  # scratch space
    numbers: Numbers | None = None
    levels: list[np.ndarray] | None = None

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.idf[terms]
        return terms, w / np.sqrt(w @ w)

    def make_blocks(self) -> None:
        term, block = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)), self.examples // BLOCK
        new = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0)) if len(term) else np.empty(0, np.int64)
        self.block_first = np.append(new, len(term))
        self.blocks, self.block_max = block[new], np.maximum.reduceat(self.values, new) if len(new) else np.empty(0)
        self.block_starts = np.searchsorted(term[new], np.arange(len(self.starts)))

    def nearest(self, terms: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine (ties by doc_id) with a positive one, block by block."""
        if self.blocks is None:
            self.make_blocks()
        spans = [(self.block_starts[t], self.block_starts[t + 1]) for t in terms]
        bound = np.zeros(-(-len(self.ids) // BLOCK))
        for x, (a, b) in zip(w, spans):
            bound[self.blocks[a:b]] += x * self.block_max[a:b]
        best_id, best = np.empty(0, np.int64), np.empty(0)
        postings = [(self.starts[t], self.starts[t + 1]) for t in terms]
        for block in np.argsort(-bound, kind="stable"):
            floor = best[k - 1] if len(best) >= k else 0.0
            if bound[block] <= 0 or bound[block] < floor - 1e-12:
                break
            first = block * BLOCK
            scores = np.zeros(BLOCK)
            for x, (a, b) in zip(w, postings):
                own = self.examples[a:b]
                i, j = np.searchsorted(own, (first, first + BLOCK))
                scores[own[i:j] - first] += x * self.values[a + i : a + j]
            hit = np.flatnonzero(scores > 0)
            best_id, best = np.append(best_id, hit + first), np.append(best, scores[hit])
            order = np.lexsort((self.ids[best_id], -np.round(best, 12)))[:k]
            best_id, best = best_id[order], best[order]
        return best_id, best

    def make_product(self) -> None:
        """The common terms' weights by example, in double precision and, term by term, in single, and their greatest by block."""
        if self.block_first is None:
            self.make_blocks()
        row, exact = common_weights(self.starts, self.examples, self.values, len(self.ids))
        rough = np.ascontiguousarray(exact.T.astype(np.float32))
        most = np.maximum.reduceat(rough, np.arange(0, len(self.ids), BLOCK), axis=1) if len(self.ids) else rough
        self.product = row, exact, rough, most

    def nearest_of_all(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """As ``nearest``, for many texts at once."""
        if self.product is None:
            self.make_product()
        row, exact, rough, most = self.product
        out = []
        margin = 4 * (len(rough) + 3) * 2.0**-24  # twice what rounding can set two scores apart
        for first in range(0, len(vectors), BATCH):
            part = vectors[first : first + BATCH]
            left = np.zeros((len(part), len(rough)), np.float32)
            split = []
            for i, (terms, w) in enumerate(part):
                at = row[terms]
                common = at >= 0
                left[i, at[common]] = w[common]
                place, weight = self._block_postings(terms[~common], w[~common])
                split.append((at[common], w[common], place, weight, self.blocks[place].astype(np.intp)))
            bound = (left @ most).astype(float)
            for own, (_, _, place, weight, block) in zip(bound, split):
                own += np.bincount(block, self.block_max[place] * weight, len(own)) + margin
            done = np.zeros(bound.shape, bool)
            floor = np.zeros(len(part))
            none = np.empty(0, np.int64), np.empty(0), np.empty(0)
            close = [none] * len(part)  # of each text, the examples that can be among its nearest: number, score, the part of it that comes from postings
            for wide in (FIRST_BLOCKS, bound.shape[1]):  # the most promising blocks, then all that can still hold a neighbour
                left_over = np.where(done | (bound <= margin) | (bound < floor[:, None]), -1.0, bound)
                if wide < left_over.shape[1]:
                    least = np.partition(left_over, -wide, axis=1)[:, -wide]
                    left_over[left_over < least[:, None]] = -1.0
                picked = left_over >= 0
                for i, found in self._compare(picked, left, rough, split, floor):
                    number, score, rare = (np.concatenate(x) for x in zip(close[i], found))
                    if len(score) >= k:
                        floor[i] = max(floor[i], np.partition(score, -k)[-k] - margin)
                        kept = score >= floor[i]
                        number, score, rare = number[kept], score[kept], rare[kept]
                    close[i] = number, score, rare
                done |= picked
            self.compared += int(done.sum())
            self.skipped += int((~done).sum())
            for (at, at_w, *_), (number, _, rare) in zip(split, close):
                cosine = rare + exact[number][:, at] @ at_w
                order = np.lexsort((self.ids[number], -np.round(cosine, 12)))[:k]
                out.append((number[order], cosine[order]))
        return out

    def _block_postings(self, terms: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the blocks of some terms, and the terms' weights beside them."""
        begin = self.block_starts[terms]
        many = self.block_starts[terms + 1] - begin
        return np.repeat(begin - np.cumsum(many) + many, many) + np.arange(int(many.sum())), np.repeat(w, many)

    def _compare(self, picked: np.ndarray, left: np.ndarray, rough: np.ndarray, split: list, floor: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Of each text, the examples of its picked blocks with a positive score that reaches its floor: number, score, the part of it that comes from postings."""
        n, wide = len(self.ids), picked.shape[1] * BLOCK
        if self.common is None or len(self.common) < len(left):
            self.common = np.zeros((len(left), picked.shape[1], BLOCK), np.float32)  # kept for the next texts; read where picked
        common = self.common
        for block in np.flatnonzero(picked.any(axis=0)).tolist():
            texts = np.flatnonzero(picked[:, block])
            product = left[texts] @ rough[:, block * BLOCK : (block + 1) * BLOCK]
            common[texts, block, : product.shape[1]] = product
        for i, (_, _, place, weight, block) in enumerate(split):
            blocks = np.flatnonzero(picked[i])
            if not len(blocks):
                continue
            chosen = np.flatnonzero(picked[i][block])
            place, weight = place[chosen], weight[chosen]
            begin = self.block_first[place]
            many = self.block_first[place + 1] - begin
            own = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            rare = np.bincount(self.examples[own], self.values[own] * np.repeat(weight, many), wide).reshape(-1, BLOCK)[blocks]
            score = common[i, blocks] + rare
            hit = np.flatnonzero((score >= floor[i]) & (score > 0))
            number = blocks[hit // BLOCK] * BLOCK + hit % BLOCK
            within = number < n  # the last block may not be full
            yield i, (number[within], score.ravel()[hit][within], rare.ravel()[hit][within])

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        """Share of toxic examples, weighted by similarity and by what each example stands for."""
        w = cosine * self.weight[near]
        return float((w * self.label[near]).sum() / w.sum()) if len(near) else 0.0

    def make_numbers(self) -> None:
        self.numbers = Numbers(self.vocabulary)
        self.levels = [self.numbers.of(level_term(self.vocabulary, k)) for k in LEVELS]  # word -> the term of its level

    def vectors_of(self, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The vector of each text over the known terms; None without any."""
        if self.numbers is None:
            self.make_numbers()
        out = []
        for piece in pieces(column):
            h, left = piece.bare()
            at = self.numbers.of(h)
            at[~left] = -1
            for a, b in zip(piece.words[:-1].tolist(), piece.words[1:].tolist()):
                own = np.sort(at[a:b])
                own = own[np.searchsorted(own, 0) :]
                if not len(own):
                    out.append(None)
                    continue
                new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                met, n = own[new], np.diff(new, append=len(own))
                more = np.concatenate([level[met[n >= k]] for k, level in zip(LEVELS, self.levels)])
                more = more[more >= 0]
                out.append(self.vector(np.concatenate([met, more]), np.concatenate([n, np.ones(len(more), n.dtype)])))
        return out

    def votes(self, column: pa.Array, k: int) -> Iterator[tuple[float | None, list[int]]]:
        """Vote (None without neighbours) and evidence of each text of a column."""
        for i in range(0, len(column), BATCH):
            vectors = self.vectors_of(column.slice(i, BATCH))
            found = iter(self.nearest_of_all([v for v in vectors if v], k))
            for v in vectors:
                near, cosine = next(found) if v else ((), ())
                yield (self.vote(near, cosine), self.ids[near].tolist()) if len(near) else (None, [])

    def votes_without_itself(self, chosen: list[int], k: int) -> Iterator[float]:
        """The votes of some examples' k nearest other examples."""
        place = np.full(len(self.ids), -1)
        place[chosen] = np.arange(len(chosen))
        own = np.flatnonzero(place[self.examples] >= 0)
        own = own[np.argsort(place[self.examples[own]], kind="stable")]
        term = np.searchsorted(self.starts, own, "right") - 1
        cuts = np.searchsorted(place[self.examples[own]], np.arange(1, len(chosen)))
        for i, (near, cosine) in zip(chosen, self.nearest_of_all(list(zip(np.split(term, cuts), np.split(self.values[own], cuts))), k + 1)):
            others = near != i
            yield self.vote(near[others][:k], cosine[others][:k])


def common_weights(starts: np.ndarray, examples: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The column of each term that more than COMMON of n examples have (-1: none), and their weights by example."""
    many = np.diff(starts)
    common = np.flatnonzero(many > COMMON * n)
    row = np.full(len(many), -1, np.int32)
    row[common] = np.arange(len(common))
    exact = np.zeros((n, len(common)))
    for i, t in enumerate(common):
        own = slice(starts[t], starts[t + 1])
        exact[examples[own], i] = values[own]
    return row, exact


def alike(weights: np.ndarray, toxic: np.ndarray, ids: np.ndarray, clusters: int = CLUSTERS, rounds: int = 8) -> np.ndarray:
    """An order in which alike examples (by their common terms) stand together, so that blocks have low bounds for other texts."""
    n = len(weights)
    if not n or not weights.shape[1]:
        return np.lexsort((ids, toxic))
    centres = weights[[0]]
    while len(centres) < min(clusters, n):  # the example farthest from all centres is the next
        centres = np.vstack([centres, weights[np.argmin((weights @ centres.T).max(axis=1))]])
    for _ in range(rounds):
        own = (weights @ centres.T).argmax(axis=1)
        centres = np.stack([weights[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return np.lexsort((ids, toxic, (weights @ centres.T).argmax(axis=1)))


ARRAYS = ("vocabulary", "idf", "ids", "label", "weight", "starts", "examples", "values", "block_starts", "blocks", "block_max", "block_first")


@dataclass
class StoredIndex:
    """An index in a folder that all executors reach: an array a file."""

    folder: str

    def write(self, index: Index) -> None:
        index.make_blocks()
        index.make_product()
        index.make_numbers()
        arrays = {name: getattr(index, name) for name in ARRAYS} | {f"product-{i}": x for i, x in enumerate(index.product)} | {f"level-{i}": x for i, x in enumerate(index.levels)} | {"slots": index.numbers.slots}
        fs, at = open_fs(self.folder)
        fs.create_dir(at, recursive=True)
        for name, x in arrays.items():
            with fs.open_output_stream(f"{at}/{name}.npy") as f:
                np.save(f, x)

    def read(self) -> Index:
        fs, at = open_fs(self.folder)

        def array(name: str) -> np.ndarray:
            """A file: memory-mapped where the folder is local, else read."""
            if fs.type_name == "local":
                x = np.load(f"{at}/{name}.npy", mmap_mode="r")
                return np.asarray(x) if x.size else np.empty(x.shape, x.dtype)
            with fs.open_input_file(f"{at}/{name}.npy") as f:
                return np.load(io.BytesIO(f.read()))

        index = Index(**{name: array(name) for name in ARRAYS})
        index.product = tuple(array(f"product-{i}") for i in range(4))
        index.numbers, index.levels = Numbers(index.vocabulary, array("slots")), [array(f"level-{i}") for i in range(len(LEVELS))]
        return index

    @property
    def value(self) -> Index:
        """Opened once a Python worker."""
        return worker_memo(("index", self.folder), self.read)


@dataclass
class Model:
    """An index within reach of every worker, and what turns its votes into scores."""

    index: StoredIndex
    steps: tuple[np.ndarray, np.ndarray]  # votes and calibrated scores
    empty_score: float  # of a text without any term

    def scores(self, column: pa.Array, k: int) -> Iterator[tuple[float, list[int]]]:
        """Score and evidence of each text of a column."""
        for vote, evidence in self.index.value.votes(column, k):
            yield (self.empty_score if vote is None else float(np.interp(vote, *self.steps))), evidence


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted pool-adjacent-violators: knots (votes, rising rates), with a half row of doubt at each end."""
    pools: list[list[float]] = []
    for a, b, c in sorted(zip(x.tolist(), y.tolist(), w.tolist())):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], top)]
    knots = np.array([p[0] / p[2] for p in pools])
    rates = np.array([(p[1] + 0.25) / (p[2] + 0.5) for p in pools])
    return knots, np.maximum.accumulate(rates)


def sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, text) of at most 2 * per_class training rows among ``docs`` (MOST_CHARS of text a label), and the training rows of each label.

    The label rows are bounded, so they are broadcast to the documents; no text is shuffled.
    """
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = labelled(rows, docs)
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    key = F.xxhash64("doc_id")
    picked = [rows.filter(F.col("toxic") == c).orderBy(key, "doc_id").limit(per_class) for c in (0, 1)]
    chosen = picked[0].unionByName(picked[1])
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    so_far = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(Window.partitionBy("toxic").orderBy(key, "doc_id"))
    return found.withColumn("_so_far", so_far).filter(F.col("_so_far") <= MOST_CHARS).drop("_so_far"), size


def associated_terms(examples: DataFrame) -> dict[int, float]:
    """Terms of the sample that lean to label 1 beyond chance: likelihood ratio over the level of chance."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(0).to_numpy()
            row = 0
            for piece in pieces(batch.column(1)):
                (h, left), n = piece.bare(), len(piece.starts)
                first, last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
                first[piece.words[:-1]], last[np.maximum(piece.words[1:] - 1, 0)] = True, True
                before, after = np.where(first[:-1], np.uint64(0), np.roll(h, 1)), np.where(last[:-1], np.uint64(0), np.roll(h, -1))
                context = mixed(before + np.uint64(3) * mixed(after, 3), 4)
                for a, b in zip(piece.words[:-1].tolist(), piece.words[1:].tolist()):
                    own = left[a:b]
                    met, at, count = np.unique(h[a:b][own], return_index=True, return_counts=True)
                    near = context[a:b][own][at]
                    terms = np.concatenate([met, *(level_term(met[count >= k], k) for k in LEVELS)])
                    near = np.concatenate([near, *(near[count >= k] for k in LEVELS)])
                    yield pa.RecordBatch.from_pydict({"term": pa.array(terms.view(np.int64)), "context": pa.array(near.view(np.int64)), "toxic": pa.array(np.full(len(terms), toxic[row], np.int32))})
                    row += 1

    total = {r["toxic"]: r["count"] for r in examples.groupBy("toxic").count().collect()}
    n0, n1 = float(total.get(0, 0)), float(total.get(1, 0))
    if not n0 or not n1:
        return {}
    once = examples.select("toxic", "text").mapInArrow(explode, "term long, context long, toxic int").distinct()
    counted = staged(once.groupBy("term").agg(F.sum("toxic").cast("double").alias("a"), F.count("*").cast("double").alias("ab")).filter("ab >= 3"), "label-terms")
    part = lambda x, e: F.when(x > 0, x * F.ln(x / e)).otherwise(0.0)
    a, b = F.col("a"), F.col("ab") - F.col("a")
    n, rest = n0 + n1, F.lit(n0 + n1) - F.col("ab")
    ratio = 2 * (part(a, F.col("ab") * n1 / n) + part(b, F.col("ab") * n0 / n) + part(n1 - a, rest * n1 / n) + part(n0 - b, rest * n0 / n))
    tested = counted.withColumn("ratio", ratio)
    tried = counted.count()
    level = 2 * np.log(max(tried, 2)) + 2.0
    kept = tested.filter((F.col("ratio") > level) & (a * n0 > b * n1))
    return {r["term"]: r["ratio"] / level for r in kept.select("term", "ratio").collect()}


def index_of(rows: list[tuple[np.ndarray, ...]], size: dict[int, int], lean: dict[int, float]) -> tuple[Index, float]:
    """The index over examples, given as parts (doc_id, toxic, number of terms, terms, times), and the score of a text without terms."""
    ids, toxic, long, terms, times = (np.concatenate([p[i] for p in rows] or [np.empty(0, kind)]) for i, kind in enumerate((np.int64, np.int64, np.int64, np.uint64, np.int32)))
    rows.clear()
    terms, term = np.unique(terms, return_inverse=True)
    term = term.astype(np.int32)
    number = Counter(toxic.tolist())
    stands = {c: size.get(c, 0) / max(1, number[c]) for c in (0, 1)}
    all_rows = size.get(0, 0) + size.get(1, 0)
    each = np.where(toxic == 1, stands[1], stands[0])
    of = lambda c: float(each[(long == 0) & (toxic == c)].sum())
    both = bool(number[0] and number[1])
    empty_score = (of(1) + 0.25) / (of(0) + of(1) + 1) if both else (size.get(1, 0) + 0.25) / (all_rows + 1)
    if not both:
        terms, term, times, long = terms[:0], term[:0], times[:0], long * 0
    order = np.lexsort((ids, toxic))
    order = order[long[order] > 0]
    place = np.zeros(len(ids), np.int32)
    place[order] = np.arange(len(order))
    example = np.repeat(place, long)
    ids, toxic, each = ids[order], toxic[order].astype(float), each[order]
    idf = np.log((1 + all_rows) / (1 + np.bincount(term, each[example], len(terms)))) + 1
    if lean and len(terms):
        leaning = np.array(list(lean), np.int64).view(np.uint64)
        idf[np.searchsorted(terms, leaning)] *= 1 + LEAN * np.array(list(lean.values()))
    value = (1 + np.log(times)) * idf[term]
    value /= np.sqrt(np.bincount(example, value * value, len(ids)))[example]
    order = np.lexsort((example, term))
    starts = np.searchsorted(term[order], np.arange(len(terms) + 1))
    # numbers anew: alike examples next to each other
    near = alike(common_weights(starts, example[order], value[order], len(ids))[1], toxic, ids)
    place = np.empty(len(ids), np.int32)
    place[near] = np.arange(len(ids))
    ids, toxic, each, example = ids[near], toxic[near], each[near], place[example]
    order = np.lexsort((example, term))
    return Index(terms, idf, ids, toxic, each, starts, example[order], value[order]), empty_score


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, k: int = NEIGHBOURS) -> Model:
    """The index over the sample. Without rows of both labels, every score is the (smoothed) training rate."""
    examples, size = sample(docs, labels, per_class)
    examples = examples.persist()
    lean = associated_terms(examples)
    spark = docs.sparkSession
    folder = new_folder(spark, "toxicity-index")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(terms_of(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t.tobytes() for t, _ in found], pa.binary()), pa.array([n.astype("<i4").tobytes() for _, n in found], pa.binary())], names=["doc_id", "toxic", "terms", "counts"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            terms, times = (np.frombuffer(b"".join(x.as_py() for x in batch.column(i)), kind) for i, kind in ((2, np.uint64), (3, np.int32)))
            rows.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.array([len(x.as_py()) // 8 for x in batch.column(2)], np.int64), terms, times))
        index, empty_score = index_of(rows, size, lean)
        own = StoredIndex(f"{folder}/{TaskContext.get().taskAttemptId()}")  # another attempt writes elsewhere
        own.write(index)
        yield pa.RecordBatch.from_pydict({"folder": [own.folder], "empty_score": [empty_score], "examples": [len(index.ids)]})

    counted = staged(examples.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), "text").mapInArrow(count, "doc_id long, toxic int, terms binary, counts binary"), "label-vectors")
    examples.unpersist()
    # at most 2 * per_class rows of MOST_CHARS a label, so one task takes them all
    built = counted.coalesce(1).mapInArrow(frugal(build), "folder string, empty_score double, examples long").collect()
    if not built:  # a table without rows may have no partition
        index, empty_score = index_of([], size, {})
        StoredIndex(folder).write(index)
        return Model(StoredIndex(folder), (np.zeros(1), np.full(1, empty_score)), empty_score)
    [(own, empty_score, n)] = built
    stored = StoredIndex(own)

    def leave_one_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, chosen = stored.value, batch.column(0).to_numpy()
            yield pa.RecordBatch.from_pydict({"vote": pa.array(list(index.votes_without_itself(chosen.tolist(), k)), pa.float64()), "label": index.label[chosen], "weight": index.weight[chosen]})

    steps = np.zeros(1), np.full(1, empty_score)
    if n:  # a row an example
        votes = spark.range(0, n, 1, spread(spark)).mapInArrow(leave_one_out, "vote double, label double, weight double").collect()
        steps = isotonic(*np.array(votes, float).T)
    return Model(stored, steps, empty_score)


def scored(docs: DataFrame, model: Model, k: int = NEIGHBOURS) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (doc_ids of the nearest examples) of every document.

    Null, empty or unknown text: the score of training texts without any term. The score depends
    on the text alone. Repeated rows are scored each; further columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(model.scores(batch.column(1), k))
            score = np.array([s for s, _ in found], float)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": score, "predicted": pa.array((score >= 0.5).astype(np.int32)), "evidence": pa.array([e for _, e in found], pa.list_(pa.int64()))})

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(work), "doc_id long, score double, predicted int, evidence array<long>")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, k: int = NEIGHBOURS) -> DataFrame:
    return scored(docs, fit(docs, labels, per_class, k), k)


def filter_stage(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, k: int = NEIGHBOURS) -> DataFrame:
    """The documents not predicted toxic, with the columns they came with; one pass, no shuffle.

    Every row is judged by its text alone: null and empty texts by the score of training texts
    without any term, repeated rows each. An empty table, or one without labelled rows of both
    kinds, loses nothing unless the training rate of toxic rows is one half or more.
    """
    model = fit(docs, labels, per_class, k)
    position = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [score < 0.5 for score, _ in model.scores(batch.column(position), k)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(frugal(work), docs.schema)
