"""Exact, memoised encoding with a byte-level BPE tokenizer file.

A byte-level pre-tokenizer cuts before every single space that stands between two
non-space characters, whatever stands around it, so the ids of a text are the ids of its
space-separated segments (each with the space before it) in a row. The same holds for a line
end between two such characters. Segments repeat far more than texts do: each is encoded once
by the tokenizers library and its ids are kept. Segments and ids are columns of Arrow, which
tells segments apart, looks them up and puts their ids in a row; no word becomes a Python object
but to be learnt.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

from tidemark.llm.common import worker_memo

_ADJACENT_SPACE = re.compile(r"\s\s")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
_MARKS = ",.;:!?"
#: Bytes of A-Z, a-z and U+00C0 to U+023F, which are letters in every version of Unicode (but for two, see
#: ``_kinds``); words of them alone are not cut by the pre-tokenizer.
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)])
_MARK = np.isin(np.arange(256), list(_MARKS.encode()))
#: The character that stands for each byte from 128 on in a byte-level vocabulary.
_HIGH = {b: chr(b if 161 <= b <= 172 or b >= 174 else 289 + b - 127 if b < 161 else 323) for b in range(128, 256)}
#: What stands for each byte of a row of words of letters (0: nothing): the space before a word is a character of the word.
_WRITTEN = np.array([list((" Ġ" if b == 32 else chr(b) if b < 128 else _HIGH[b]).encode().ljust(3, b"\0")) for b in range(256)], np.uint8)
_TOGETHER = 1024  # new segments that are encoded as one text


def _buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array of large strings or binaries."""
    _, offsets, data = array.buffers()
    if not len(array):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    return np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1], np.frombuffer(data or b"", np.uint8)


def _kinds(segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which segments are letters alone, and which are letters with one mark after them."""
    at, data = _buffers(segments)
    other = ~_LETTER[data]
    other[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the signs of times and division
    before = np.concatenate([[0], np.cumsum(other)])
    n, others = np.diff(at), np.diff(before[at])
    last = data[np.maximum(at[1:] - 1, 0)] if len(data) else np.zeros(len(n), np.uint8)
    return (n > 0) & (others == 0), (n > 1) & (others == 1) & _MARK[last]


def _interleaved(first: pa.Array, second: pa.Array, is_second: np.ndarray) -> pa.Array:
    """The rows of two arrays in one, by which of them each row is from."""
    order = np.where(is_second, len(first) + np.cumsum(is_second) - 1, np.cumsum(~is_second) - 1)
    return pa.concat_arrays([first, second]).take(pa.array(order))


class SegmentEncoder:
    """Ids of whole texts.

    ``max_entries`` bounds the memo, never the result: a full memo is replaced by the segments of
    the last call.
    """

    def __init__(self, path: str, end_id: int, max_entries: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(*vocabulary.values(), end_id) < 65_536 else "<u4")
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of text that an id stands for
        added = {i for i in self.tokenizer.get_added_tokens_decoder()}
        for token, i in vocabulary.items():
            self.width[i] = len(token.encode() if i in added else token)
        self.letters = None
        if not any(_kinds(pa.array([t.content.strip()], pa.large_string()))[0][0] for t in self.tokenizer.get_added_tokens_decoder().values()):
            self.letters = Tokenizer(self.tokenizer.model)  # for words of letters, given by the characters of their bytes
            self.letters.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.end = np.array([end_id], self.dtype).tobytes()
        self.marks = [self._alone(chr(b)) if _MARK[b] else None for b in range(256)]
        self.max_entries = max_entries
        self.known = pa.array([], pa.large_string())
        self.ids = pa.array([], pa.large_binary())

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, segments: pa.Array) -> pa.Array:
        """Ids of new segments (written without the space before them, but with a line end).

        Words of letters go to the vocabulary's merges without the pre-tokenizer, which would leave
        them whole. All other segments but those with spaces at an end stand side by side as one
        text. Ids are dealt out by the bytes that each id stands for.
        """
        plain = _kinds(segments)[0] & (self.letters is not None)
        words, others, dealt = segments.filter(pa.array(plain)), segments.filter(pa.array(~plain)).to_pylist(), []
        for k in range(0, len(words), _TOGETHER):
            own = words.slice(k, _TOGETHER)
            text = _WRITTEN[np.frombuffer(" ".join(["", *own.to_pylist()]).encode(), np.uint8)].ravel()
            dealt.append(self._deal(self.letters, text[text > 0].tobytes().decode(), np.diff(_buffers(own)[0]) + 1))
        texts = [s if s[:1] == "\n" else " " + s for s in others]
        alone = [not s or s[-1].isspace() for s in others]
        together, of_others = [t for t, a in zip(texts, alone) if not a], []
        for k in range(0, len(together), _TOGETHER):
            own = together[k : k + _TOGETHER]
            of_others.append(self._deal(self.tokenizer, "".join(own), [len(t.encode()) for t in own]))
        apart = pa.array([self._alone(t) for t, a in zip(texts, alone) if a], pa.large_binary())
        none = pa.array([], pa.large_binary())
        of_others = _interleaved(pa.concat_arrays([none, *of_others]), apart, np.array(alone, bool))
        return _interleaved(of_others, pa.concat_arrays([none, *dealt]), plain)

    def _deal(self, tokenizer: Tokenizer, text: str, sizes: Iterable[int]) -> pa.Array:
        """The ids of each of the segments that stand side by side in a text, by the bytes of each."""
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        cuts = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(sizes)) + 1
        at = np.concatenate([[0], cuts]) * self.dtype.itemsize
        return pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text with the end id; a null text is empty.

        Segments are cut and told apart by Arrow, so each is looked up once a call, and Arrow
        puts their ids side by side.
        """
        heads, rests, odd = [], [], {}  # what no space stands before, and what follows
        for i, t in enumerate(texts):
            if t and _ADJACENT_SPACE.search(t):
                head, *odd[i] = _SAFE_CUT.split(t)
                rest = None
            else:
                head, space, rest = (t or "").replace("\n", " \n").partition(" ")
                rest = rest if space else None
            heads.append(head)
            rests.append(rest)
        cut = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        ends = cut.offsets.to_numpy().astype(np.int64)
        segments = pa.chunked_array([cut.values, pa.array([s for x in odd.values() for s in x], pa.large_string())]).combine_chunks()
        odd_ends = ends[-1] + np.cumsum([0, *map(len, odd.values())])
        first, last = ends[:-1].copy(), ends[1:].copy()
        first[list(odd)], last[list(odd)] = odd_ends[:-1], odd_ends[1:]
        found = segments.dictionary_encode()
        del rests, cut, ends, segments  # much of the call's memory; the ids need as much again
        at, data = _buffers(self._together(found.dictionary).take(found.indices))
        data, end = memoryview(data), self.end
        return [b"".join((self._alone(h) if h else b"", data[a:b], end)) for h, a, b in zip(heads, at[first].tolist(), at[last].tolist())]

    def _together(self, segments: pa.Array) -> pa.Array:
        """The ids of different segments. A word with one mark after it is cut before the mark by the pre-tokenizer, so it is put together from both."""
        marked = _kinds(segments)[1]
        if not marked.any():
            return self._remembered(segments)
        at, data = _buffers(segments)
        marks = pa.array([self.marks[b] for b in data[at[1:][marked] - 1].tolist()], pa.large_binary())
        plain, stems = segments.filter(pa.array(~marked)), pc.utf8_rtrim(segments.filter(pa.array(marked)), _MARKS)
        words = pa.concat_arrays([plain, stems]).dictionary_encode()
        ids = self._remembered(words.dictionary).take(words.indices)
        return _interleaved(ids[: len(plain)], pc.binary_join_element_wise(ids[len(plain) :], marks, pa.scalar(b"", pa.large_binary())), marked)

    def _remembered(self, segments: pa.Array) -> pa.Array:
        """The ids of different segments, from the memo or learnt."""
        at = pc.index_in(segments, value_set=self.known).fill_null(-1).to_numpy().copy()
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return self.ids.take(pa.array(at))
        new = segments.take(pa.array(missing))
        ids = pa.concat_arrays([self.ids, self._learn(new)])
        at[missing] = len(self.known) + np.arange(len(missing))
        out = ids.take(pa.array(at))
        if len(ids) <= self.max_entries:
            self.known, self.ids = pa.concat_arrays([self.known, new]), ids
        else:
            keep = pa.array(np.arange(min(len(segments), self.max_entries)))  # copied, so that the rest is freed
            self.known, self.ids = segments.take(keep), out.take(keep)
        return out


def encoder_for(path: str, end_id: int) -> SegmentEncoder:
    """One encoder a Python worker: its memo serves all tasks that the worker runs."""
    return worker_memo(("encoder", path, end_id), lambda: SegmentEncoder(path, end_id))
