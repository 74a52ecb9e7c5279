"""Suffix arrays by induced sorting, for numpy arrays of small alphabets.

Suffixes are classified as smaller (S) or larger (L) than their successor.
The leftmost-smaller ones (LMS) are sorted first: their substrings by inducing,
then, where substrings repeat, by naming runs of 2, 4, 8 ... substrings
recursively.  All other suffixes are induced from them in one scan upwards and
one downwards.  A scan handles a bucket of equal first symbols at a time, so it
takes linear work in vector operations.
"""

from __future__ import annotations

import numpy as np


def classify(text: np.ndarray) -> np.ndarray:
    """True for S suffixes; the end of the text counts as smallest, so the last suffix is L."""
    n = len(text)
    rising = np.zeros(n, bool)
    rising[:-1] = text[:-1] < text[1:]
    differs = np.ones(n, bool)
    differs[:-1] = text[:-1] != text[1:]
    at = np.where(differs, np.arange(n, dtype=np.int32), np.int32(n))
    following = np.minimum.accumulate(at[::-1])[::-1]  # equal neighbours have the type of the next change
    return rising[following]


class _Scan:
    """Lists of suffixes by bucket, filled in chunks."""

    def __init__(self, symbols: int):
        self.chunks: list[list[np.ndarray]] = [[] for _ in range(symbols)]

    def take(self, c: int) -> np.ndarray:
        return np.concatenate(self.chunks[c]) if self.chunks[c] else np.zeros(0, np.int32)

    def put(self, text: np.ndarray, suffixes: np.ndarray) -> None:
        """Appends to the buckets of the first symbols, in order."""
        if not len(suffixes):
            return
        first = text[suffixes]
        order = np.argsort(first, kind="stable")
        first, suffixes = first[order], suffixes[order]
        cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
        for c, part in zip(first[np.r_[0, cuts]].tolist(), np.split(suffixes, cuts), strict=True):
            self.chunks[c].append(part)


def induce(text: np.ndarray, smaller: np.ndarray, lms: list[np.ndarray], symbols: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """L and S suffixes of each bucket in order, from its LMS suffixes in order."""
    n = len(text)
    larger: list[np.ndarray] = []
    up = _Scan(symbols)
    up.put(text, np.array([n - 1], np.int32))  # the last suffix, induced by the end of the text
    for c in range(symbols):
        found, now = [], up.take(c)
        while len(now):
            found.append(now)
            before = now[now > 0] - 1
            before = before[~smaller[before]]
            same = text[before] == c
            up.put(text, before[~same])
            now = before[same]
        larger.append(np.concatenate(found) if found else np.zeros(0, np.int32))
        before = lms[c]
        up.put(text, before[before > 0] - 1)
    down = _Scan(symbols)
    less: list[np.ndarray] = [np.zeros(0, np.int32)] * symbols
    for c in range(symbols - 1, -1, -1):
        found, now = [], down.take(c)
        while len(now):
            found.append(now)
            before = now[now > 0] - 1
            before = before[smaller[before]]
            same = text[before] == c
            down.put(text, before[~same])
            now = before[same]
        if found:
            less[c] = np.concatenate(found)[::-1]
        before = larger[c][::-1]
        before = before[before > 0] - 1
        down.put(text, before[smaller[before]])
    return larger, less


def _by_bucket(text: np.ndarray, suffixes: np.ndarray, symbols: int) -> list[np.ndarray]:
    first = text[suffixes]
    order = np.argsort(first, kind="stable")
    return np.split(suffixes[order], np.searchsorted(first[order], np.arange(1, symbols)))


def _sort_names(names: np.ndarray, rounds: int | None) -> np.ndarray:
    """Order of the suffixes of a string of names, by naming runs of twice the length again and again."""
    step = 1
    names = names.astype(np.int64)
    while True:
        top = int(names.max()) + 2
        if top - 1 == len(names) or rounds == 0:
            return np.argsort(names)
        after = np.zeros_like(names)
        after[:-step] = names[step:] + 1
        pairs = names * top + after
        order = np.argsort(pairs)
        ordered = pairs[order]
        fresh = np.zeros(len(names), np.int64)
        fresh[1:] = np.cumsum(ordered[1:] != ordered[:-1])
        names = np.empty_like(names)
        names[order] = fresh
        step *= 2
        rounds = None if rounds is None else rounds - 1
        if step >= len(names):
            return np.argsort(names)


def suffix_array(text: np.ndarray, symbols: int, depth: int | None = None) -> np.ndarray:
    """The suffixes of ``text`` in order; with ``depth`` only the first so many symbols need be in order."""
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    smaller = classify(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + 1
    if len(lms):
        _, less = induce(text, smaller, _by_bucket(text, lms, symbols), symbols)
        by_substring = np.concatenate(less)
        starts = np.zeros(n, bool)
        starts[lms] = True
        by_substring = by_substring[starts[by_substring]]
        number = np.empty(n, np.int32)
        number[lms] = np.arange(len(lms), dtype=np.int32)
        ends = np.minimum(np.append(lms[1:], n - 1) + 1, n)  # a substring takes in the first symbol of the next
        rank = number[by_substring]
        size = ends - lms
        a, b = rank[1:], rank[:-1]
        differ = (size[a] != size[b]) | (a == len(lms) - 1) | (b == len(lms) - 1)
        alike = np.flatnonzero(~differ)
        want = size[a[alike]] if depth is None else np.minimum(size[a[alike]], depth)
        differ[alike] = common_prefixes(text, lms[a[alike]], lms[b[alike]], want) < want
        names = np.empty(len(lms), np.int64)
        names[rank] = np.r_[0, np.cumsum(differ)]
        rounds = None if depth is None else max(1, int(np.ceil(np.log2(max(depth / 2, 2)))))
        lms = lms[_sort_names(names, rounds)]
    larger, less = induce(text, smaller, _by_bucket(text, lms, symbols), symbols)
    return np.concatenate([x for pair in zip(larger, less, strict=True) for x in pair])


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray | int) -> np.ndarray:
    """How many symbols, at most ``most``, the suffixes from each a and b share; four symbols are compared at once."""
    n = len(text)
    padded = np.zeros(n + 4, np.uint16)
    padded[:n] = text
    four = np.ndarray((n + 1,), np.uint64, padded, strides=(2,))  # the four symbols from every place
    room = np.minimum(n - np.maximum(a, b), most).astype(np.int64)
    out, step = room.copy(), 0
    at = np.flatnonzero(room > 0)
    while len(at):
        apart = four[a[at] + step] ^ four[b[at] + step]
        ended = np.flatnonzero(apart)
        if len(ended):
            x = apart[ended]
            same = (x & np.uint64(0xFFFF) == 0).astype(np.int64)
            same += (x & np.uint64(0xFFFFFFFF) == 0).astype(np.int64) + (x & np.uint64(0xFFFFFFFFFFFF) == 0)
            out[at[ended]] = np.minimum(step + same, room[at[ended]])
        step += 4
        at = at[(apart == 0) & (room[at] > step)]
    return out


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place of the text, how many symbols (at most ``most``) its suffix shares with the one before it in the order."""
    out = np.zeros(len(text), np.int32)
    before = np.full(len(text), -1, np.int32)
    before[order[1:]] = order[:-1]
    at = np.flatnonzero(before >= 0)
    out[at] = common_prefixes(text, at, before[at], most)
    return out
