"""Words and word shingles of whole texts, as arrays over a batch of documents.

A word is a run of bytes outside space and \\x09-\\x0D; A-Z are lower-cased. Every word gets a 64-bit
value from running sums over the bytes, so a batch is hashed without a Python step per word. Texts are
taken in slices of a megabyte, which bounds the arrays; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000
#: Odd multipliers of the hash; any odd numbers do, all executors must use the same.
BASE = 0x9E3779B97F4A7C15
STEPS = np.array([(BASE * (2 * k + 1) ** 3) & 0xFFFFFFFFFFFFFFFF | 1 for k in range(1, 9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser over 64 bits: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_LOWERED = _VALUE[_LOWER]
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        inverse = pow(BASE, -1, 1 << 64)
        for name, base in (("up", BASE), ("down", inverse)):
            steps = np.full(max(n, SLICE_BYTES), base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def lower(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return _LOWER[data]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return (np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)), offsets


@dataclass
class Slice:
    """Consecutive documents ``first .. first + n``; words as byte ranges of ``data``."""

    first: int
    n: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    counts: np.ndarray
    sizes: np.ndarray


@dataclass
class Part:
    """Consecutive texts ``first .. first + n`` as bytes, each from ``at[i]`` to ``at[i + 1]``."""

    first: int
    n: int
    data: np.ndarray
    at: np.ndarray


def parts(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Part]:
    data, offsets = text_buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield Part(i, j - i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    for p in parts(column, limit):
        yield cut(p.first, p.data, p.at)


def cut(first: int, data: np.ndarray, at: np.ndarray) -> Slice:
    n = len(at) - 1
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    before = np.empty(len(data), dtype=bool)
    before[:1] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1:] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    doc = np.searchsorted(at, starts, side="right") - 1
    # an empty document shares its offset with the next one; side="right" gives the one that holds bytes
    return Slice(first, n, data, starts, ends, doc, np.bincount(doc, minlength=n)[:n], np.diff(at))


class Spans:
    """64-bit values of byte ranges of one slice, from one running sum. A-Z count as a-z unless ``lowered`` is off."""

    def __init__(self, data: np.ndarray, lowered: bool = True) -> None:
        self.up, self.down = _power(len(data))
        self.total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((_LOWERED if lowered else _VALUE)[data] * self.up[: len(data)], out=self.total[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        return mix((self.total[ends] - self.total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def word_hash(s: Slice) -> np.ndarray:
    return Spans(s.data).of(s.starts, s.ends)


def shingles(s: Slice, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Values and documents of all shingles in text order, repeats included.

    A document with fewer words than ``size`` has its whole sequence as one shingle, one without words none.
    """
    words = word_hash(s)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(s.counts)[:-1]])
    left = first[s.doc] + s.counts[s.doc] - np.arange(len(words))
    full = np.flatnonzero(left >= size)
    value = np.full(len(full), BASE * size & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for k in range(size):
        value += words[full + k] * STEPS[k % 8] if size <= 8 else mix(words[full + k] + np.uint64(k)) * STEPS[k % 8]
    doc = s.doc[full]
    short = np.flatnonzero((s.counts > 0) & (s.counts < size))
    if len(short):
        tail = s.counts[short].astype(np.uint64) * np.uint64(BASE)
        for k in range(size - 1):
            has = s.counts[short] > k
            tail[has] += words[first[short[has]] + k] * STEPS[k % 8]
        value, doc = np.concatenate([value, tail]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        value, doc = value[order], doc[order]
    return mix(value), doc


def shingle_sets(s: Slice, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document: values, sorted within a document, and the documents."""
    value, doc = shingles(s, size)
    ends = np.cumsum(np.bincount(doc, minlength=s.n))
    at = 0
    for end in ends:
        value[at:end].sort()
        at = end
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[keep], doc[keep]


def sequence_hash(s: Slice) -> np.ndarray:
    """A value of each document's word sequence; documents that differ in case or white space only share it."""
    words = word_hash(s)
    first = np.concatenate([[0], np.cumsum(s.counts)])
    place = (np.arange(len(words)) - first[s.doc] + 1).astype(np.uint64)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(mix(words + place * np.uint64(BASE)), out=total[1:])
    return mix(total[first[1:]] - total[first[:-1]] + s.counts.astype(np.uint64))
