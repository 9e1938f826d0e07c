"""64-bit hashes of all words of many texts at once.

Words are runs of bytes other than \\x20 and \\x09-\\x0D of the UTF-8 text, with A-Z lower-cased. The
prefix sums H[i] = sum of (c[k] + 1) * B^k over k < i, modulo 2^64 with an odd B, give the hash of
any span of bytes as (H[end] - H[start]) * B^-start, so all words of a batch of texts are hashed
by a few array operations, without a Python object for any of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1_000_000
MARKS = b"#*$%&|<>!"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER_BIT, _UPPER_BIT = np.uint16(1 << 14), np.uint16(1 << 15)

_codes = np.arange(256)
_SPACE = (_codes == 32) | ((_codes >= 9) & (_codes <= 13))
_LOWERED = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)
#: Printable ASCII characters that are neither letters nor digits.
_EDGE = np.array([33 <= c < 127 and not chr(c).isalnum() for c in _codes])
#: A bit for each of MARKS, one for a-z and one for A-Z.
_FLAGS = np.zeros(256, np.uint16)
for _k, _c in enumerate(MARKS):
    _FLAGS[_c] = 1 << _k
_FLAGS[97:123], _FLAGS[65:91] = _LOWER_BIT, _UPPER_BIT

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _reserve(n: int) -> None:
    while len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            own = _powers[k]
            _powers[k] = np.concatenate([own, own * np.uint64(pow(base, len(own), 1 << 64))])


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread hashes over all bits; another salt gives other hashes."""
    h = h + np.uint64((0xD1B54A32D192ED03 * (salt + 1)) & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Piece:
    """Some texts of a batch, whole: their bytes, and their words by number."""

    first: int  # number of the first text in its batch
    data: np.ndarray
    offsets: np.ndarray  # first byte of each text, and the end
    sums: np.ndarray  # H
    starts: np.ndarray  # first byte of each word, and its end
    ends: np.ndarray
    words: np.ndarray  # first word of each text, and the end

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def spans(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        """Hashes of spans of the lower-cased bytes."""
        return mixed((self.sums[ends] - self.sums[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64), salt)

    def hashes(self) -> np.ndarray:
        return self.spans(self.starts, self.ends)

    def beginnings(self, n: int) -> np.ndarray:
        """Hashes of the first n bytes of each word."""
        return self.spans(self.starts, np.minimum(self.starts + n, self.ends), 1)

    def bare(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words without punctuation at their ends, and whether anything is left."""
        inner = ~(_EDGE | _SPACE)[self.data]
        at, before = np.flatnonzero(inner), np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(inner, out=before[1:])
        left = before[self.ends] > before[self.starts]
        start, end = self.starts.copy(), self.ends.copy()
        start[left], end[left] = at[before[self.starts[left]]], at[before[self.ends[left]] - 1] + 1
        return self.spans(start, end), left

    def flags(self) -> np.ndarray:
        """Bits of the characters met in each word."""
        return np.bitwise_or.reduceat(_FLAGS[self.data], self.starts) if len(self.starts) else np.empty(0, np.uint16)

    def marks(self) -> np.ndarray:
        """How often each of MARKS stands in each text."""
        kind = _FLAGS[self.data]
        at = np.flatnonzero((kind > 0) & (kind < 1 << len(MARKS)))
        text = np.searchsorted(self.offsets, at, "right") - 1
        which = np.log2(kind[at].astype(float)).astype(np.int64)
        return np.bincount(text * len(MARKS) + which, minlength=len(self) * len(MARKS)).reshape(len(self), len(MARKS))

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all lines, and the first line of each text."""
        ends = np.flatnonzero(self.data == 10)
        cuts = np.sort(np.concatenate([self.offsets[1:], ends]), kind="stable")
        starts = np.sort(np.concatenate([self.offsets[:-1], ends + 1]), kind="stable")
        first = np.searchsorted(ends, self.offsets) + np.arange(len(self.offsets))
        return self.spans(starts, np.maximum(cuts, starts)), first


def pieces(column: pa.Array) -> Iterator[Piece]:
    """The texts of an Arrow column in pieces of about PIECE_BYTES; a text is never cut, a null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(what, np.uint8) if what is not None and what.size else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, "right")) - 1)
        yield piece(data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first], first)
        first = end


def piece(data: np.ndarray, offsets: np.ndarray, first: int = 0) -> Piece:
    n = len(data)
    _reserve(n)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    outside = np.ones(n + 2, bool)
    outside[1:-1] = ~inside
    starts = np.flatnonzero(inside & (outside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside & (outside[2:] | edge[1:])) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWERED[data].astype(np.uint64) + np.uint64(1)) * _powers[0][:n], out=sums[1:])
    return Piece(first, data, offsets, sums, starts, ends, np.searchsorted(starts, offsets))


def of_texts(texts: list[str | None]) -> Piece:
    """One piece of a few texts."""
    column = pa.array([t or "" for t in texts], pa.large_string())
    found = [len((t or "").encode()) for t in texts]
    _, _, what = column.buffers()
    data = np.frombuffer(what, np.uint8)[: sum(found)] if what is not None and what.size else np.empty(0, np.uint8)
    return piece(data, np.concatenate([[0], np.cumsum(found)]).astype(np.int64))
