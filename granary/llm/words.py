"""Word-level kernels on Arrow batches, shared by the operators of this package.

A word is ``[^\\x20\\x09-\\x0D]+``; on UTF-8 bytes that is exactly what ``bytes.split()``
yields, so no regular expression runs over the corpus.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Multipliers of the rolling hash over the words of an n-gram, odd and fixed.
_MULT = np.array([int.from_bytes(xxhash.xxh3_64_digest(b"mult%d" % i), "little") | 1 for i in range(64)], dtype=np.uint64)


class WordIds(dict):
    """bytes -> 64-bit hash; keeps at most ``bound`` words, the first met, which are the frequent ones."""

    def __init__(self, bound: int = 600_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        v = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.bound:
            self[word] = v
        return v

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not glibc: there is nothing to trim

    def _trim(_: int) -> int:
        return 0


_live: dict[object, object] = {}


def worker_cache(name: object, make):
    """What ``make`` made under this name in this worker process; a new name drops all others.

    So a reused worker holds the caches of one operator, whatever ran in it before.
    """
    if name not in _live:
        _live.clear()
        gc.collect()
        _live[name] = make()
    return _live[name]


def release() -> None:
    """Drops what this worker process holds for other operators."""
    if _live:
        _live.clear()
        gc.collect()


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a slice holds about ``max_bytes`` of text (one text at least).

    At the end of a task freed memory goes back to the system, as reused workers live long.
    """
    for b in batches:
        if not b.num_rows:
            continue
        i = b.schema.get_field_index(column)
        a = b.column(i)
        size = np.asarray(pc.fill_null(pc.binary_length(a), 0), dtype=np.int64)
        group = np.cumsum(size) // max_bytes
        cuts = np.flatnonzero(np.diff(group)) + 1
        edges = [0, *cuts.tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if hi > lo:
                yield b.slice(lo, hi - lo)
    _trim(0)


def raw(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def split_all(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts in a row, and each text's start among them (n + 1 numbers)."""
    words: list[bytes] = []
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    for i, t in enumerate(texts):
        words += t.split()
        starts[i + 1] = len(words)
    return words, starts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on; the last n - 1 places are missing."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = ids[:m] * _MULT[0]
    for k in range(1, n):
        h = h + ids[k : k + m] * _MULT[k]
    return mix(h)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=schema.field(k).type) for k, c in columns.items()], schema=schema)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: A random number a byte value; the second table gives A-Z those of a-z.
_BYTE = np.array([int.from_bytes(xxhash.xxh3_64_digest(b"byte%d" % i), "little") for i in range(256)], dtype=np.uint64)
_BYTE_LOW = _BYTE.copy()
_BYTE_LOW[65:91] = _BYTE[97:123]
CHUNK = 1 << 20  #: bytes hashed at once


def _running(base: int) -> np.ndarray:
    t = np.full(CHUNK, base, np.uint64)
    t[0] = 1
    return np.multiply.accumulate(t)


@functools.cache
def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for the places of a chunk."""
    return _running(_BASE), _running(_BASE_INVERSE)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in a row, and each text's start among them (n + 1 numbers); null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_words(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of the texts in a row, and each text's start among them.

    A word's hash is a polynomial over its bytes, taken from running sums over the buffer, so no
    word becomes a Python object. ``lower`` makes A-Z and a-z equal. Sums run over ``CHUNK`` bytes
    at a time and are carried on, so a text (or a word) of any length needs no more than that
    besides the hashes.
    """
    data, offsets = text_buffer(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    up, down = _power_tables()
    values = _BYTE_LOW if lower else _BYTE
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    places, before, after = [], [], []
    carry = 0
    for lo in range(0, len(data), CHUNK):
        own = data[lo : lo + CHUNK]
        hi = lo + len(own)
        space = _SPACE[own]
        begins = ~space
        ends = begins.copy()
        begins[1:] &= space[:-1]
        ends[:-1] &= space[1:]
        if lo:
            begins[0] &= _SPACE[data[lo - 1]]
        if hi < len(data):
            ends[-1] &= _SPACE[data[hi]]
        for marks, at in ((begins, first), (ends, last)):
            at = at[np.searchsorted(at, lo) : np.searchsorted(at, hi)] - lo
            marks[at] |= ~space[at]
        at, to = np.flatnonzero(begins), np.flatnonzero(ends)
        total = values[own] * up[: len(own)]
        np.cumsum(total, out=total)
        scale, back = np.uint64(pow(_BASE, lo, 1 << 64)), np.uint64(pow(_BASE_INVERSE, lo, 1 << 64))
        start = np.uint64(carry)
        sums = lambda i: start + scale * total[i]
        places.append(back * down[at])
        before.append(np.where(at > 0, sums(np.maximum(at, 1) - 1), start))
        after.append(sums(to))
        carry = int(sums(np.array([len(own) - 1]))[0])
        at += lo
        places[-1] = (places[-1], at)
    at = np.concatenate([p[1] for p in places])
    hashes = (np.concatenate(after) - np.concatenate(before)) * np.concatenate([p[0] for p in places])
    return mix(hashes), np.searchsorted(at, offsets)
