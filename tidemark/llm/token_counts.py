"""Operator 10: token counts by heap-and-linked-list byte-pair merging.

For each word the symbols form a doubly linked list and the mergeable adjacent pairs a heap by
rank; the lowest pair is popped and merged until none is left. A word's count is its initial
symbols less its merges. No identifiers are produced.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import worker_memo
from tidemark.llm.token_output import text_batches

_CUT = re.compile(r"[ \n]+")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in kept:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class MergeCounter:
    """Counts of the tokens of whole texts under a word-level BPE file (JSON of the tokenizers library).

    Supported file: NFC, white space folding and lower case as normaliser; a word pattern, then
    bytes, as pre-tokenizer; BPE with an end-of-word suffix; special tokens that are cut out of
    the raw text first. ``max_entries`` bounds the memo of word counts, never the result.
    """

    def __init__(self, path: str, max_entries: int = 1_000_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: r for r, p in enumerate(pairs)}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.symbols = byte_symbols()
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)))
        self.max_entries = max_entries
        self.segments: dict[str, int] = {}  # counts of segments of raw text
        self.words: dict[str, int] = {}  # counts of normalised words, kept apart: the same string may stand for both

    def count_word(self, word: str) -> int:
        """Initial symbols less merges of one pre-token."""
        symbols = [self.symbols[b] for b in word.encode()]
        symbols[-1] += self.suffix
        n, ranks = len(symbols), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j >= n or symbols[i] != left or symbols[j] != right:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = left + right, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                r = ranks.get((symbols[i], symbols[after[j]]))
                if r is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[after[j]]))
            if before[i] >= 0:
                r = ranks.get((symbols[before[i]], symbols[i]))
                if r is not None:
                    heapq.heappush(heap, (r, before[i], symbols[before[i]], symbols[i]))
            count -= 1
        return count

    def _count_segment(self, segment: str) -> int:
        """A run without spaces or line ends: special tokens out first, then words."""
        total, at = 0, 0
        for m in self.special.finditer(segment):
            total += self._count_plain(segment[at : m.start()]) + 1
            at = m.end()
        return total + self._count_plain(segment[at:])

    def _count_plain(self, text: str) -> int:
        text = unicodedata.normalize("NFC", text)
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        known, total = self.words, 0
        for word in self.word.findall(text):
            n = known.get(word)
            if n is None:
                n = known[word] = self.count_word(word)
            total += n
        return total

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; null counts as empty.

        No normalisation and no word crosses a space or a line end, so the count is the sum over
        the segments between them; counts of segments are kept.
        """
        if not text:
            return 0
        known = self.segments
        if len(known) + len(self.words) > self.max_entries:
            known.clear()
            self.words.clear()
        total = 0
        for s in _CUT.split(text):
            n = known.get(s)
            if n is None:
                n = known[s] = self._count_segment(s)
            total += n
        return total


def counter_for(path: str) -> MergeCounter:
    """One counter a Python worker: its memo serves all tasks that the worker runs."""
    return worker_memo(("counter", path), lambda: MergeCounter(path))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document; null text: 0 bytes, 0 tokens.

    Repeated rows are counted as often as they stand; texts are counted whole, however long;
    further columns are not read; an empty table gives an empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(tokenizer_path)
        for batch in batches:
            for ids, texts in text_batches(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = np.fromiter(map(counter.count, texts), np.int64, len(texts))
                size = np.fromiter((len(t.encode()) if t else 0 for t in texts), np.int64, len(texts))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_bytes": size, "n_tokens": n, "over_limit": n > limit})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
