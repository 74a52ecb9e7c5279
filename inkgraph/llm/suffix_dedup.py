"""Suffix-array dedup of repeated byte strings.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document
with a smaller id.  Only strings that can repeat are sorted: by winnowing,
every such string has one anchor, the least of its k-gram hashes, and equal
strings have equal anchors.  Texts are kept in blocks; each block asks shards
which of its anchors occur in another text, and sends only the surroundings of
those, each to the shard of its anchor.  A shard builds the suffix array of
its distinct surroundings by induced sorting, groups the strings that share
``LENGTH`` bytes by the permuted common prefixes, and answers which strings
have a smaller document.  An anchor's rows are at most one for each block.

Whole copies of a smaller document are told by digest and only answered for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import SpanHash, distinct_spans, runs
from .jaccard import _bloom, bloom_has
from .sais import permuted_common_prefixes, suffix_array
from .storage import scratch, written
from .text_blocks import batch as _batch
from .text_blocks import pack as _pack
from .text_blocks import read_blocks, shard_count, table, text_blocks
from .text_blocks import unpack as _unpack

LENGTH, GRAM = 50, 24
#: Suffixes that a shard sorts at once, about; more are sorted in parts, by anchor.
SHARD_BYTES = 1 << 20
#: Blocks of text whose anchors a shard gets at most, about.
SHARD_BLOCKS = 8


def _digest(text: bytes, doc_id: int | None = None) -> int:
    key = text if doc_id is None else hashlib.blake2b(text, digest_size=16).digest() + str(doc_id).encode()
    return int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little", signed=True)


def _first_copies(texts: DataFrame, rows: int) -> np.ndarray:
    """A bit map that holds each (id, text) which is the first of its text; false members do no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, data, ends in read_blocks(batches):
            at = [i for i, x in enumerate(ids) if x is not None]
            each = [data[ends[i] : ends[i + 1]].tobytes() for i in at]
            both = [hashlib.blake2b(t, digest_size=16).digest() for t in each]
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.binary()), pa.array([ids[i] for i in at], pa.int64()), pa.array([_digest(t, ids[i]) for t, i in zip(each, at, strict=True)], pa.int64())], names=["digest", "doc_id", "mark"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.ascontiguousarray(batch.column("mark").to_numpy()).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([marks], pa.binary()), pa.array([b""], pa.binary())], names=["a", "b"])

    first = texts.mapInArrow(run, "digest binary, doc_id long, mark long").groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    return _bloom(first.select(F.col("first.mark").alias("mark")).mapInArrow(packed, "a binary, b binary"), rows)


def _known_and_copies(ids: list, data: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which texts of a block have an id, and which of them copy a text of a smaller id."""
    known = np.array([i is not None for i in ids], bool)
    marks = np.array([_digest(data[a:b].tobytes(), i) if i is not None else 0 for a, b, i in zip(ends, ends[1:], ids, strict=False)], np.int64)
    return known, known & ~bloom_has(first, marks)


class Anchors:
    """The anchor of every string of LENGTH bytes in one block of texts."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, active: np.ndarray, length: int, gram: int):
        n = len(data)
        self.starts = np.zeros(0, np.int64)
        self.owned = np.zeros(0, np.int64)
        self.hashes = np.zeros(0, np.uint64)
        self.docs = np.zeros(0, np.int64)
        if n < length:
            return
        # the place takes the lowest bits, so that runs of one anchor can be told; equal grams have equal upper bits
        value = SpanHash(data).windows(gram) & ~np.uint64(63) | (np.arange(n - gram + 1, dtype=np.uint64) & np.uint64(63))
        width, reach = length - gram + 1, 1
        while reach < width:  # the least of `width` hashes, by doubling
            step = min(reach, width - reach)
            value = np.minimum(value[step:], value[:-step])
            reach += step
        owner = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))
        whole = (owner[: n - length + 1] == owner[length - 1 :]) & active[owner[: n - length + 1]]
        at = np.flatnonzero(whole)
        if not len(at):
            return
        value = value[at]
        fresh = np.r_[True, (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)]
        self.starts = at[fresh]
        self.owned = np.diff(np.append(np.flatnonzero(fresh), len(at)))
        self.hashes = value[fresh] >> np.uint64(6)
        self.docs = owner[self.starts]


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return data[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


def _split(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)


def _ask(texts: DataFrame, first, length: int, gram: int, shards: int) -> DataFrame:
    """The distinct anchors of each block, by shard, and which of them stand in several of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, data, ends in read_blocks(batches):
            known, copies = _known_and_copies(ids, data, ends, first.value)
            anchors = Anchors(data, ends, known & ~copies, length, gram)
            shard = _split(anchors.hashes, shards)
            order = np.lexsort((anchors.docs, anchors.hashes, shard))
            shard, hashes, doc = shard[order], anchors.hashes[order], anchors.docs[order]
            new = np.r_[True, hashes[1:] != hashes[:-1]] if len(hashes) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(hashes)) - 1 if len(at) else at
            several = doc[at] != doc[last]
            short = hashes[at].astype(np.uint32)
            rows = [(block, s, short[a:b].tobytes(), np.packbits(several[a:b]).tobytes()) for s, a, b in runs(shard[at])]
            yield _batch("block shard anchors several", [pa.int64(), pa.int32(), pa.binary(), pa.binary()], rows)

    return texts.mapInArrow(run, "block long, shard int, anchors binary, several binary")


def _shared_anchors(key, table):
    """For each block, which of its anchors in this shard stand in two texts or two blocks."""
    parts = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("anchors")]
    flags = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8))[: len(p)] for x, p in zip(table.column("several"), parts, strict=True)]
    distinct, at, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    several = np.bincount(at, weights=np.concatenate(flags), minlength=len(distinct)) > 0
    shared = np.split((several | (count > 1))[at], np.cumsum([len(p) for p in parts])[:-1])
    found = [np.sort(p[s]).tobytes() for p, s in zip(parts, shared, strict=True)]
    return pa.table({"block": table.column("block"), "shard": table.column("shard"), "anchors": pa.array(found, pa.binary())})


_NEAR = "shard int, block long, starts binary, owned binary, ids binary, text binary"
_NEAR_TYPES = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _surroundings(first, length: int, gram: int, shards: int):
    """Cogroup function: the surroundings of a block's shared anchors, by shard."""

    def run(key, left, right):
        rows = []
        for block, ids, data, ends in read_blocks(left):
            known, copies = _known_and_copies(ids, data, ends, first.value)
            anchors = Anchors(data, ends, known & ~copies, length, gram)
            ids = np.array([-1 if x is None else x for x in ids], np.int64)
            shard, short = _split(anchors.hashes, shards), anchors.hashes.astype(np.uint32)
            order = np.argsort(shard, kind="stable")
            place = {s: (a, b) for s, a, b in runs(shard[order])}
            for s, found in zip(right.column("shard").to_pylist(), right.column("anchors").to_pylist(), strict=True):
                known = np.frombuffer(found, np.uint32)
                at = order[slice(*place.get(s, (0, 0)))]
                at = at[np.isin(short[at], known)]
                if len(at):
                    starts, owned = anchors.starts[at], anchors.owned[at]
                    text = _gather(data, starts, owned + length - 1)
                    rows.append((s, block, _pack(starts.astype(np.int32)), owned.astype(np.uint8).tobytes(), _pack(ids[anchors.docs[at]]), zstandard.ZstdCompressor(level=1).compress(text.tobytes())))
        return table(" ".join(x.split()[0] for x in _NEAR.split(", ")), _NEAR_TYPES, rows)

    return run


def least_documents(contexts: np.ndarray, sizes: np.ndarray, owned: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For every owned string of every context in turn, the least id of the contexts that hold it.

    ``contexts`` are the concatenated distinct contexts, each with the least id it was found in.
    """
    text = np.zeros(len(contexts) + len(sizes), np.uint16)  # zero ends a context
    at = np.arange(len(contexts)) + np.repeat(np.arange(len(sizes)), sizes)
    text[at] = contexts.astype(np.uint16) + 1
    first = np.cumsum(sizes + 1) - (sizes + 1)
    places = np.repeat(first - (np.cumsum(owned) - owned), owned) + np.arange(int(owned.sum()))
    order = suffix_array(text, 257, length)
    own = np.zeros(len(text), bool)
    own[places] = True
    order = order[own[order]]  # equal strings stand together among the owned ones as among all
    common = permuted_common_prefixes(text, order, length)
    group = np.empty(len(text), np.int32)
    group[order] = np.cumsum(common[order] < length)
    least = np.full(len(order) + 1, np.iinfo(np.int64).max, np.int64)
    np.minimum.at(least, group[places], np.repeat(ids, owned))
    return least[group[places]]


def _answer(length: int, gram: int):
    """Group function of a shard: for each block, its anchors' starts and the strings (bits) with a smaller document."""

    def run(key, near):
        owned = [np.frombuffer(x.as_buffer(), np.uint8).astype(np.int64) for x in near.column("owned")]
        ids = np.concatenate([_unpack(x.as_py(), np.int64) for x in near.column("ids")])
        text = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(x.as_py()) for x in near.column("text")), np.uint8)
        rows = [len(x) for x in owned]
        owned = np.concatenate(owned)
        sizes = owned + length - 1
        starts = np.cumsum(sizes) - sizes
        _, which = distinct_spans(text, starts, starts + sizes)  # numbered in the order in which they come first
        first = np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1))
        least_id = np.full(len(first), np.iinfo(np.int64).max, np.int64)
        np.minimum.at(least_id, which, ids)
        order = np.argsort(which, kind="stable")
        bounds = np.searchsorted(which[order], np.arange(len(first) + 1))
        bits = np.zeros(len(owned), np.uint32)
        for part in _parts(text, starts, sizes, first, length, gram):  # one is held at a time
            c = first[part]
            found = least_documents(_gather(text, starts[c], sizes[c]), sizes[c], owned[c], least_id[part], length)
            begin = np.repeat(np.cumsum(owned[c]) - owned[c], bounds[part + 1] - bounds[part])
            at = _gather(order, bounds[part], bounds[part + 1] - bounds[part])  # all rows of these contexts
            for w in range(int(owned[c].max())):
                some = np.flatnonzero(w < owned[at])
                bits[at[some]] |= (found[begin[some] + w] < ids[at[some]]).astype(np.uint32) << np.uint32(w)
        cuts = np.cumsum(rows)[:-1]
        out = []
        for block, start, b in zip(near.column("block").to_pylist(), near.column("starts").to_pylist(), np.split(bits, cuts), strict=True):
            some = b > 0
            if some.any():
                out.append((block, _pack(_unpack(start, np.int32)[some]), _pack(b[some])))
        return table("block starts bits", [pa.int64(), pa.binary(), pa.binary()], out)

    return run


def _parts(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, length: int, gram: int) -> list[np.ndarray]:
    """Distinct contexts in parts of bounded size; equal strings stay in one part, as they share an anchor."""
    size = sizes[first]
    parts = int(size.sum()) // SHARD_BYTES + 1
    if parts == 1:
        return [np.arange(len(first))] if len(first) else []
    least, total, a = np.empty(len(first), np.uint64), np.cumsum(size), 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + SHARD_BYTES, side="right")))
        begin = np.cumsum(size[a:b]) - size[a:b]
        hashes = np.append(SpanHash(_gather(text, starts[first[a:b]], size[a:b])).windows(gram), ~np.uint64(0))
        # the anchor is in every owned string, so from the start of the last to the end of the first
        least[a:b] = np.minimum.reduceat(hashes, np.stack([begin + size[a:b] - length, begin + length - gram + 1], 1).ravel())[::2]
        a = b
    group = (least >> np.uint64(7)) % np.uint64(parts)
    order = np.argsort(group, kind="stable")
    return [p for p in np.split(order, np.searchsorted(group[order], np.arange(1, parts))) if len(p)]


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finish(first, length: int, keep: bool):
    def run(key, left, right):
        out = []
        for _, ids, data, ends in read_blocks(left):
            _, copies = _known_and_copies(ids, data, ends, first.value)
            hits = [np.zeros(0, np.int64)]
            for starts, bits in zip(right.column("starts").to_pylist(), right.column("bits").to_pylist(), strict=True):
                starts, bits = _unpack(starts, np.int32).astype(np.int64), _unpack(bits, np.uint32)
                hits += [starts[(bits >> np.uint32(w)) & np.uint32(1) > 0] + w for w in range(32)]
            hits = np.concatenate(hits)
            change = np.bincount(hits, minlength=len(data) + 1) - np.bincount(hits + length, minlength=len(data) + 1)
            gone = np.cumsum(change[:-1]) > 0
            sizes = np.diff(ends)
            for i in np.flatnonzero(copies & (sizes >= length)):
                gone[ends[i] : ends[i + 1]] = True
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            begin = ends[:-1][sizes > 0]
            opens[begin] = gone[begin]
            total = lambda x: np.diff(np.r_[0, np.cumsum(x)][ends])
            kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(total(gone), pa.int64()), pa.array(total(opens), pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            if keep:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept")
            out.append(pa.table(columns, names=names))
        return pa.concat_tables(out) if out else pa.table({x.split()[0]: pa.array([], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]) for x in (SCHEMA + ", kept binary" * keep).split(", ")})

    return run


def dedup_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shards: int | None = None, keep: bool = False) -> DataFrame:
    """One row for each row of ``docs``: bytes, removed bytes, removed runs, digest of the rest; with ``keep`` the rest itself.

    Null texts are empty.  Rows that share an id never remove each other's strings; rows with a null
    id keep everything and remove nothing.  An empty table gives an empty result.  Strings are
    compared by their bytes; whole copies by 128-bit digests.
    """
    if length - gram + 1 > 32:
        raise ValueError("at most 32 strings share an anchor")
    spark = docs.sparkSession
    with scratch() as kept:
        texts = text_blocks(docs)
        shards = shards or shard_count(texts, SHARD_BLOCKS)
        first = spark.sparkContext.broadcast(_first_copies(texts, docs.count()))
        shared = _ask(texts, first, length, gram, shards).groupBy("shard").applyInArrow(_shared_anchors, "block long, shard int, anchors binary")
        near = texts.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_surroundings(first, length, gram, shards), _NEAR)
        answers = written(near.groupBy("shard").applyInArrow(_answer(length, gram), "block long, starts binary, bits binary"), "answers")
        out = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_finish(first, length, keep), SCHEMA + ", kept binary" * keep)
        return kept(written(out, "deduped"))
