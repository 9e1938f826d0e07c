"""Operator 5: fingerprints from prefix polynomial hashes.

For a text c[0..n) the prefix hash H[i] = sum of c[k] * B^k over k < i, modulo a prime, answers
the equality of any two spans: equal spans have equal differences of prefix hashes once both
are brought to the same power. Two primes under 2^31 make the pair about 62 bits. Because
equality of prefixes is monotone in their length, the longest common extension of two texts from
two places is found by binary search.

A fingerprint keeps the prefix array at anchors: places whose next eight characters' hash ends in
``level`` zero bits, so the same passage has the same anchors wherever it stands. The level grows
with the logarithm of the length, so a fingerprint has about 50 to 100 anchors (every place of
a short text is one; in a long stretch without any, places at equal distances from the last are)
and a size that does not depend on the text's. Two fingerprints are compared
at the anchors of the higher level: from each pair of anchors with the same next characters, the
longest common extension from anchor to anchor is found by binary search on the kept prefix
hashes, and the likeness is the length of all passages so found, none counted twice, over the
longer text. An edit costs only the stretch between the anchors around it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import spread

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (911_382_323, 972_663_749)
WINDOW = 8
ANCHORS = 48
END = 63  # level of the two ends of a text


@dataclass
class Fingerprint:
    """Length, level, and for each anchor its place, level, seed (hash of the next characters) and prefix hashes."""

    n: int
    level: int
    at: np.ndarray
    levels: np.ndarray
    seeds: np.ndarray  # 0 where fewer characters follow
    sums: tuple[np.ndarray, np.ndarray]

    def __str__(self) -> str:
        """Length, level and the anchors in hexadecimal."""
        sums = self.sums[0] << np.uint64(31) | self.sums[1]
        parts = (self.at.astype(">u4"), self.levels.astype("u1"), self.seeds.astype(">u4"), sums.astype(">u8"))
        return f"{self.n:x}:{self.level:x}:" + ":".join(x.tobytes().hex() for x in parts)

    def thinned(self, level: int) -> tuple[list[int], list[int], list[list[int]]]:
        """Places, seeds and prefix hashes of the anchors of at least ``level``."""
        keep = self.levels >= level
        return self.at[keep].tolist(), self.seeds[keep].tolist(), [x[keep].tolist() for x in self.sums]


class PrefixHashes:
    """Powers that grow with the longest text met; arrays and fingerprints of texts on request."""

    def __init__(self):
        self.powers = [np.ones(1, np.uint64) for _ in PRIMES]
        self.inverses = [np.ones(1, np.uint64) for _ in PRIMES]

    def _reserve(self, n: int) -> None:
        while len(self.powers[0]) <= n:
            for k, (p, b) in enumerate(zip(PRIMES, BASES)):
                for own, base in ((self.powers, b), (self.inverses, pow(b, -1, p))):
                    step = pow(base, len(own[k]), p)
                    own[k] = np.concatenate([own[k], own[k] * np.uint64(step) % np.uint64(p)])

    def arrays(self, text: str) -> list[np.ndarray]:
        """For each prime the n + 1 prefix hashes of the text's code points."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self._reserve(len(codes))
        out = []
        for p, power in zip(PRIMES, self.powers):
            h = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(codes * power[: len(codes)] % np.uint64(p), out=h[1:])
            out.append(h % np.uint64(p))
        return out

    def _same(self, x, a: int, b: int, i: int, y, c: int, d: int, j: int) -> bool:
        """Whether the span between the prefix hashes x[a] and x[b], from place i, equals that of y from place j."""
        for p, power, u, v in zip(PRIMES, self.powers, x, y):
            if (int(u[b]) - int(u[a])) * int(power[j]) % p != (int(v[d]) - int(v[c])) * int(power[i]) % p:
                return False
        return True

    def spans_equal(self, x: list[np.ndarray], i: int, y: list[np.ndarray], j: int, length: int) -> bool:
        """Whether x's span of ``length`` at i equals y's at j."""
        return self._same(x, i, i + length, i, y, j, j + length, j)

    def common_extension(self, x: list[np.ndarray], i: int, y: list[np.ndarray], j: int) -> int:
        """Longest length at which the spans from i and j agree."""
        low, high = 0, min(len(x[0]) - 1 - i, len(y[0]) - 1 - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.spans_equal(x, i, y, j, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def fingerprint(self, text: str, h: list[np.ndarray] | None = None) -> Fingerprint:
        """``h``: the text's arrays, where they are at hand."""
        h = self.arrays(text) if h is None else h
        n = len(h[0]) - 1
        level = max(0, (n // ANCHORS).bit_length() - 1)
        seeds, levels = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.int64)
        if n >= WINDOW:
            p, x = np.uint64(PRIMES[0]), h[0]
            seeds[: n - WINDOW + 1] = (x[WINDOW:] + p - x[: n - WINDOW + 1]) % p * self.inverses[0][: n - WINDOW + 1] % p + np.uint64(1)
            spread_out = seeds[: n - WINDOW + 1] * np.uint64(0x9E3779B97F4A7C15)
            spread_out ^= spread_out >> np.uint64(32)
            low = spread_out & (~spread_out + np.uint64(1))  # the lowest bit set
            levels[: n - WINDOW + 1] = np.minimum(np.log2(np.maximum(low, 1).astype(float)).astype(np.int64), END - 1)
        levels[[0, n]] = END
        at = np.flatnonzero(levels >= level)
        gap = 4 << level
        for i in np.flatnonzero(np.diff(at) > gap):  # long stretches without an anchor, as in text that repeats itself
            levels[at[i] + gap : at[i + 1] : gap] = level
        at = np.flatnonzero(levels >= level)
        return Fingerprint(n, level, at, levels[at], seeds[at], (h[0][at], h[1][at]))

    def likeness(self, x: Fingerprint, y: Fingerprint) -> float:
        """Length of the common passages over that of the longer text; 1 for equal fingerprints (empty ones too)."""
        if x.n == y.n and all(a[-1] == b[-1] for a, b in zip(x.sums, y.sums)):
            return 1.0
        if not x.n or not y.n:
            return 0.0
        self._reserve(max(x.n, y.n))
        level = max(x.level, y.level)
        (at, seeds, hx), (to, others, hy) = x.thinned(level), y.thinned(level)
        where: dict[int, list[int]] = {}
        for j in range(len(others) - 1, -1, -1):
            if others[j]:
                where.setdefault(others[j], []).append(j)
        number = {place: j for j, place in enumerate(to)}
        used, same, i = [False] * len(to), 0, 0
        while i < len(at) - 1:
            found, own = 0, where.get(seeds[i], ())
            while own:
                j = own.pop()
                if used[j]:
                    continue
                last = used.index(True, j) if True in used[j:] else len(to) - 1
                # anchors that both texts have at the same distance from these two
                both = [(i + k, b) for k, place in enumerate(at[i:]) if (b := number.get(place - at[i] + to[j])) is not None and b <= last]
                low, high = 0, len(both) - 1
                while low < high:
                    mid = (low + high + 1) // 2
                    if self._same(hx, i, both[mid][0], at[i], hy, j, both[mid][1], to[j]):
                        low = mid
                    else:
                        high = mid - 1
                if low:
                    found = both[low][0] - i
                    used[j : both[low][1]] = [True] * (both[low][1] - j)
                    same += at[i + found] - at[i]
                    break
            i += max(found, 1)
        return same / max(x.n, y.n)


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points (rounded down) replaced by as many first ones of ``following``."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def in_order_with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, guest, doc_id, text), dealt by ranges of doc_id and sorted within each.

    The first row of every range stands at the end of the range before it as a guest, and that
    of the first range at the end of the last, so each row's successor is in its own partition:
    texts are shuffled once. Range bounds are document ids, at most ``buckets`` of them; a null
    id comes first.
    """
    shares = [k / buckets for k in range(buckets)]
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    low, cuts = docs.select(key.alias("key")).agg(F.min("key"), F.percentile_approx("key", shares, 100 * buckets)).first()
    bounds = sorted({low, *(cuts or [])}) if low is not None else []
    if not bounds:
        return rows.select(F.lit(0).alias("bucket"), F.lit(False).alias("guest"), "doc_id", "text")
    own = F.size(F.filter(F.lit(bounds), lambda b: b <= F.col("key"))) - 1
    rows = rows.withColumn("bucket", own)
    first = rows.filter(F.col("key").isin(bounds)).withColumn("bucket", F.pmod(F.col("bucket") - 1, F.lit(len(bounds))))
    both = rows.withColumn("guest", F.lit(False)).unionByName(first.withColumn("guest", F.lit(True)))
    return both.repartitionById(len(bounds), "bucket").sortWithinPartitions("bucket", "guest", "key", "text").select("bucket", "guest", "doc_id", "text")


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, same_prefix.

    ``same_prefix`` is the longest common extension of the text and its edited text from their
    starts, on the full prefix arrays.
    Null text: empty. Rows of equal doc_id follow each other by text; a lone row is its own
    successor. Further columns are not read. Fingerprints of equal texts are equal.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, made = PrefixHashes(), None, []

        def finish(doc_id, text, arrays, own, following, next_own) -> dict:
            edited = edited_text(text, following)
            h = hashes.arrays(edited)
            e = hashes.fingerprint(edited, h)
            return {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(), "fingerprint": str(own), "edited_fingerprint": str(e), "near_edited": hashes.likeness(own, e), "near_next": hashes.likeness(own, next_own), "same_prefix": hashes.common_extension(arrays, 0, h, 0)}

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                bucket, guest, doc_id, text = row
                arrays = hashes.arrays(text)
                own = hashes.fingerprint(text, arrays)
                if held and held[0] == bucket:
                    made.append(finish(*held[1:], text, own))
                held = None if guest else (bucket, doc_id, text, arrays, own)
                if len(made) == 256:
                    yield pa.RecordBatch.from_pylist(made, schema)
                    made = []
        if made:
            yield pa.RecordBatch.from_pylist(made, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("same_prefix", pa.int64())])
    ordered = in_order_with_next(docs, buckets or spread(docs.sparkSession))
    return ordered.mapInArrow(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_prefix long")
