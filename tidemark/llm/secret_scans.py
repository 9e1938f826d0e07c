"""Operator 11: secret scans by token efficiency.

Three base kinds are plain patterns: assignments to a secret's name, access key ids, and long runs
of hexadecimal digits. The method adds a fourth kind, ``random``: a run of characters that a
byte-pair vocabulary can only spell in short pieces. Words of any language fall into tokens of
several characters, random strings into tokens of one or two, so a run of at least LEAST
characters with at most MOST_RATIO characters a token is reported, unless it is a known digest or
identifier (see ``is_known``) or touches a base span. A run in one case without digits is measured
in lower case, for vocabularies hold few capital words.

Base patterns count only ASCII letters as letters in either case. A span is the whole match,
in code points, its end exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import worker_memo

KINDS = ("assign", "access", "hex", "random")
LEAST = 20
MOST_RATIO = 2.0
PIECE_BYTES = 4_000_000

# The base patterns, and the least length of what they match.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: Every assignment has one of these in the lower-case text.
NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")

RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}")
#: Lengths of hexadecimal digests: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGESTS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
INTEGRITY = re.compile(r"sha(256-[A-Za-z0-9+/]{43}=|384-[A-Za-z0-9+/]{64}|512-[A-Za-z0-9+/]{86}==)")
HEXADECIMAL = re.compile(r"(?:(?:md5|sha-?(?:1|224|256|384|512))[=_-]?)?((?:[0-9a-f]+)|(?:[0-9A-F]+))", re.ASCII)
NUMBERS = re.compile(r"[0-9+/_.=-]+")

_TAKEN = np.zeros(256, bool)
_TAKEN[[c for c in range(128) if chr(c).isalnum() or chr(c) in "+/_.=-"]] = True


def is_known(run: str) -> bool:
    """Digests (hexadecimal of a digest's length, also after its name; integrity values), UUIDs, and
    identifiers of digits alone (numbers, dates, versions, addresses, in any grouping)."""
    m = HEXADECIMAL.fullmatch(run)
    return bool(m and len(m[1]) in DIGESTS or UUID.fullmatch(run) or INTEGRITY.fullmatch(run) or NUMBERS.fullmatch(run))


class Vocabulary:
    """Token counts of short strings under a tiktoken file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def tokens(self, run: str) -> int:
        return len(self.encoding.encode_ordinary(run.lower() if run.isalpha() and run.isupper() else run))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST_HEX]


def random_spans(text: str, base: list[tuple[int, int, int]], vocabulary: Vocabulary, most_ratio: float = MOST_RATIO) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of runs of few characters a token that touch no base span."""
    out, base, k = [], sorted(base), 0
    ends = np.maximum.accumulate([e for _, _, e in base]).tolist() if base else []
    for m in RUN.finditer(text):
        run = m[0].lstrip("+/_.=-")
        start = m.end() - len(run)
        run = run.rstrip("+/_.-")
        if len(run) < LEAST:
            continue
        end = start + len(run)
        while k < len(base) and base[k][0] < end:
            k += 1
        if k and ends[k - 1] > start or is_known(run):
            continue
        if len(run) <= most_ratio * vocabulary.tokens(run):
            out.append((start, 3, end))
    return out


def suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Numbers of the texts (bytes between offsets) that hold a run of LEAST characters or a secret's name.

    Every access key, long hexadecimal run and random run is such a run, so no other text has a span.
    """
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _TAKEN[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = ends - starts >= LEAST  # a run over the border of two texts only makes both suspects
    first, last = np.searchsorted(offsets, starts[long], "right") - 1, np.searchsorted(offsets, ends[long] - 1, "right") - 1
    found = [np.arange(a, b + 1) for a, b in zip(first.tolist(), last.tolist())]
    lowered = data.tobytes().lower()
    for name in NAMES:
        at, where = lowered.find(name), []
        while at >= 0:
            k = int(np.searchsorted(offsets, at, "right"))
            where.append(k - 1)
            at = lowered.find(name, max(at + 1, int(offsets[k]) - len(name) + 1 if k < len(offsets) else at + 1))
        found.append(np.array(where, np.int64))
    found = np.unique(np.concatenate(found)).astype(np.int64)
    return found[(found >= 0) & (found < len(offsets) - 1)]


def _described(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_scan(docs: DataFrame, vocabulary_path: str, pattern: str, most_ratio: float = MOST_RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every document.

    Null and empty texts have no spans (the digest of the empty string). Texts are scanned whole,
    however long; repeated rows are scanned each; a null doc_id stays; further columns are not
    read; an empty table gives an empty result. Spans of equal starts stand in the order of KINDS.
    """
    nothing = hashlib.sha256(b"").hexdigest()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            n = len(texts)
            counts, digests, spans = np.zeros((n, 4), np.int64), [nothing] * n, [""] * n
            _, where, what = texts.buffers()
            offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
            data = np.frombuffer(what, np.uint8) if what is not None and what.size else np.empty(0, np.uint8)
            first = 0
            while first < n:
                end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, "right")) - 1)
                for i in (first + suspects(data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first])).tolist():
                    text = texts[i].as_py()
                    base = sorted(base_spans(text))
                    vocabulary = worker_memo(("vocabulary", vocabulary_path), lambda: Vocabulary(vocabulary_path, pattern))
                    added = random_spans(text, base, vocabulary, most_ratio)
                    for _, k, _ in base + added:
                        counts[i, k] += 1
                    digests[i], spans[i] = hashlib.sha256(_described(base).encode()).hexdigest(), _described(sorted(base + added))
                first = end
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_assign": counts[:, 0], "n_access": counts[:, 1], "n_hex": counts[:, 2], "base_sha256": digests, "spans": spans, "n_random": counts[:, 3]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
