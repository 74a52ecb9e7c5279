"""Arrow string columns seen as numpy byte buffers.

Operators that need Python work on whole Arrow batches: one byte array and one
offset array per block, no string object per row.  Blocks are cut at
``BLOCK_BYTES`` so that memory is bounded by the block, or by one text if a
single text is longer.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20

#: A-Z to a-z, every other byte unchanged.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

#: True for bytes of words ``[^\x20\x09-\x0D]+``.
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[32, 9, 10, 11, 12, 13]] = False

#: True for bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in lower-cased text.
ALNUM_WORDS = np.ones(256, dtype=bool)
ALNUM_WORDS[0x00:0x30] = False
ALNUM_WORDS[0x3A:0x61] = False
ALNUM_WORDS[0x7B:0x80] = False


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = text_buffer(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
    trim()


def trim() -> None:
    """Gives freed memory back; workers live on between tasks, and what they keep is taken from the tasks of others."""
    pa.default_memory_pool().release_unused()
    malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if malloc_trim:
        malloc_trim(0)


def word_spans(data: np.ndarray, ends: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more entry at the end)."""
    n = len(data)
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = ends[1:-1]
    cuts = cuts[cuts < n]
    first[cuts] = inside[cuts]  # a word never crosses into the next text
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = cuts[cuts > 0] - 1
    last[before] = inside[before]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, ends)


def distinct_spans(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct contents of spans that do not overlap and stand in order, and the number of each span's content."""
    sizes = stops - starts
    ends = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    if len(starts) and (starts[1:] == stops[:-1]).all():
        joined = np.ascontiguousarray(data[starts[0] : stops[-1]])
    else:
        joined = data[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])]
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(joined)]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def digests(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, key: bytes) -> np.ndarray:
    """128-bit digests of spans under a key, as two columns of uint64; equal digests stand for equal contents.

    The key is drawn for each run (``new_key``), so no text can be made whose pieces meet others by
    their digests.  Up to 15 bytes go, with their number, through a keyed permutation, so no two of
    them share a digest; longer spans are digested one by one, each distinct content once.
    """
    sizes = stops - starts
    keys = np.frombuffer(hashlib.blake2b(key, digest_size=64).digest(), np.uint64)
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 8,), np.uint64, padded, strides=(1,))  # the eight bytes from every place
    low = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    a = eight[starts] & low[np.minimum(sizes, 8)] ^ keys[0]
    b = eight[np.minimum(starts + 8, len(data))] & low[np.clip(sizes - 8, 0, 7)] | (sizes.astype(np.uint64) << np.uint64(56))
    b ^= keys[1]
    for k in (2, 4):
        a += mix(b ^ keys[k])
        b += mix(a ^ keys[k + 1])
    out = np.stack([a, b], 1)
    long = np.flatnonzero(sizes > 15)
    if len(long):
        contents, number = distinct_spans(data, starts[long], stops[long])
        each = b"".join([hashlib.blake2b(x, digest_size=16, key=key).digest() for x in contents.to_pylist()])
        out[long] = np.frombuffer(each, np.uint64).reshape(-1, 2)[number]
    return out


def new_key() -> bytes:
    return os.urandom(16)


_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        _tables[:] = [_geometric(_MULTIPLIER, size), _geometric(inverse, size), mix(np.arange(1, 257, dtype=np.uint64))]
    return _tables[0], _tables[1], _tables[2]


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done, step = 1, base & _MASK
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(step)
        step, done = step * step & _MASK, done + take
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; ``x`` is uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class SpanHash:
    """64-bit hashes of arbitrary spans of one array of symbols, from prefix sums.

    They choose shards and candidates; spans of equal hashes are not taken as equal.
    """

    def __init__(self, symbols: np.ndarray):
        power, self._inverse, table = _powers(len(symbols) + 1)
        value = table[symbols] if symbols.dtype == np.uint8 else mix(symbols.astype(np.uint64) + np.uint64(1))
        value = value * power[: len(symbols)]
        self._sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(value, out=self._sums[1:])

    def spans(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mix((self._sums[stops] - self._sums[starts]) * self._inverse[starts])

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all spans of one size, by start."""
        return mix((self._sums[size:] - self._sums[:-size]) * self._inverse[: len(self._sums) - size])


def joined_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` consecutive entries; len(hashes) - k + 1 of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= np.uint64(_MULTIPLIER)
        out += hashes[i : i + n]
    return mix(out)


def runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of each run of equal numbers of a sorted array: as many as there are values, however large these are."""
    values, first = np.unique(x, return_index=True)
    return list(zip(values.tolist(), first.tolist(), np.append(first, len(x))[1:].tolist(), strict=True))
