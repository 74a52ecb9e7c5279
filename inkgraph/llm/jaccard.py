"""Exact n-gram Jaccard self-join by vertical partitioning, and its components.

Texts with the same set of word shingles form one class.  All shingles have a
global order, rare before frequent, by exact counts.  Classes that share a
shingle among the first of their sets are candidates (the prefix filter, with
the bound that two places in the order give).  To verify them the shingles are
cut into fragments: each fragment counts the overlap of its part of both sets,
and the counts are summed for each pair.

Candidates of one shingle are first compared with the class that has the least
place in the order, which ties large groups of near copies together in one
round; further rounds compare them with another class each, as long as that
ties many more.  Then all remaining candidates that are not yet in one component
are compared, in tiles of bounded size that are dealt to all tasks, so no link
between components is lost and a group's pairs are not spelled out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buffers import ASCII_LOWER, SPACE_WORDS, digests, joined_hash, mix, new_key, runs, word_spans
from .components import components
from .storage import drop, scratch, small_batches, sweep, written
from .text_blocks import batch as _batch
from .text_blocks import pack as _pack
from .text_blocks import read_blocks, shard_count, table, text_blocks
from .text_blocks import unpack as _unpack
from .tiles import PROGRESS, deal, each_tile, open_entries, pairs_of_tile, stars

K, PERCENT = 5, 75
SLICES = 16
#: Bytes of the segments of a fragment, about.
FRAGMENT_BYTES = 32 << 20
#: Pairs whose elements are compared at once, in elements.
CHUNK = 2_000_000


def shingle_sets(data: np.ndarray, ends: np.ndarray, k: int, key: bytes) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has one, an empty text none.

    A shingle's hash is made of its words' 128-bit digests under ``key``.
    """
    data = ASCII_LOWER[data]
    starts, stops, first = word_spans(data, ends, SPACE_WORDS)
    two = digests(data, starts, stops, key)
    words = mix(two[:, 0] ^ mix(two[:, 1]))
    grams = joined_hash(words, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        else:
            yield joined_hash(words[a:b], b - a) ^ np.uint64(b - a) if b > a else words[:0]


def node_of(s: np.ndarray) -> int:
    """64-bit id of a set of hashes."""
    both = np.array([np.bitwise_xor.reduce(mix(s ^ np.uint64(0xA5A5A5A5))), s.sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)
    return int(mix(both[:1] * np.uint64(0x9E3779B97F4A7C15) + both[1:]).view(np.int64)[0])


class Block:
    """The distinct sets of one block of texts, and its distinct shingles in the order in which shards are asked for them."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, k: int, key: bytes, shards: int):
        self.sizes, self.node_of_row, self.nodes, self.sets = [], [], [], []
        seen: set[int] = set()
        for s in shingle_sets(data, ends, k, key):
            self.sizes.append(len(s))
            node = node_of(s) if len(s) else None
            self.node_of_row.append(node)
            if node is not None and node not in seen:
                seen.add(node)
                self.nodes.append(node)
                self.sets.append(s)
        every = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        # the low bits choose the shard and the next ones tell shingles apart there
        shard = every % np.uint64(shards)
        self.distinct, self.place, self.count = np.unique(shard << np.uint64(32) | every >> np.uint64(12) & np.uint64(0xFFFFFFFF), return_inverse=True, return_counts=True)
        self.runs = runs(self.distinct >> np.uint64(32))  # of the shards that occur


def _ask(texts: DataFrame, k: int, key: bytes, shards: int) -> DataFrame:
    """The distinct shingles of each block and in how many of its sets each is, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, data, ends in read_blocks(batches):
            b = Block(data, ends, k, key, shards)
            short, count = b.distinct.astype(np.uint32), np.minimum(b.count, 65535).astype(np.uint16)
            rows = [(number, s, short[x:y].tobytes(), _pack(count[x:y])) for s, x, y in b.runs]
            yield _batch("block shard shingles counts", [pa.int64(), pa.int32(), pa.binary(), pa.binary()], rows)

    return texts.mapInArrow(run, "block long, shard int, shingles binary, counts binary")


def _frequencies(key, asked):
    """For each block the frequency classes of its shingles; 0 is a shingle of one set alone."""
    parts = [np.frombuffer(x.as_buffer(), np.uint32) for x in asked.column("shingles")]
    distinct, at = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([_unpack(x.as_py(), np.uint16) for x in asked.column("counts")]), minlength=len(distinct))
    classes = np.minimum(np.ceil(8 * np.log2(total)), 255).astype(np.uint8)[at]
    split = np.split(classes, np.cumsum([len(p) for p in parts])[:-1])
    return pa.table({"block": asked.column("block"), "shard": asked.column("shard"), "classes": pa.array([_pack(x) for x in split], pa.binary())})


_PREFIXES = "doc_id n node shard nodes sizes counts keys places"
_PREFIX_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
_PREFIX_SCHEMA = "doc_id long, n long, node long, shard int, nodes binary, sizes binary, counts binary, keys binary, places binary"


def _prefixes(k: int, key: bytes, percent: int, shards: int):
    """Cogroup function: a row for each text with its set's size and id, and the prefixes of a block's sets, by shard of the shingle.

    Shingles of one set alone come first in the order and meet nothing, so only their number is kept.
    """

    def run(_, left, right):
        out = []
        for _, ids, data, ends in read_blocks(left):
            b = Block(data, ends, k, key, shards)
            none = pa.nulls
            rows = len(ids)
            out.append(pa.table({n: c for n, c in zip(_PREFIXES.split(), [pa.array(ids, pa.int64()), pa.array(b.sizes, pa.int64()), pa.array(b.node_of_row, pa.int64()), *(none(rows, t) for t in _PREFIX_KINDS[3:])], strict=True)}))
            if not b.sets:
                continue
            classes, place = np.zeros(len(b.distinct), np.uint8), {s: (x, y) for s, x, y in b.runs}
            for s, packed in zip(right.column("shard").to_pylist(), right.column("classes").to_pylist(), strict=True):
                classes[slice(*place[s])] = _unpack(packed, np.uint8)
            frequency = classes[b.place].astype(np.uint64)
            lengths, keys, places, at = [], [], [], 0
            for s in b.sets:
                n = len(s)
                order = np.sort(frequency[at : at + n] << np.uint64(56) | s & np.uint64((1 << 56) - 1))
                at += n
                alone = int(np.searchsorted(order, np.uint64(1 << 56)))
                stop = n - (percent * n + 99) // 100 + 1
                keys.append(order[alone : max(stop, alone)])
                lengths.append(len(keys[-1]))
                places.append(np.arange(alone, alone + lengths[-1], dtype=np.int32))
            keys, places = np.concatenate(keys), np.concatenate(places)
            owner = np.repeat(np.arange(len(b.sets)), lengths)
            shard = ((keys >> np.uint64(3)) % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            short = (keys >> np.uint64(20)).astype(np.uint32)
            nodes, sizes = np.array(b.nodes, np.int64), np.array([len(s) for s in b.sets], np.int32)
            found = []
            for i, start, end in runs(shard[order]):
                x = order[start:end]
                used, count = np.unique(owner[x], return_counts=True)
                found.append((None, None, None, i, nodes[used].tobytes(), sizes[used].tobytes(), _pack(count.astype(np.int32)), short[x].tobytes(), _pack(places[x])))
            out.append(table(_PREFIXES, _PREFIX_KINDS, found))
        return pa.concat_tables(out) if out else table(_PREFIXES, _PREFIX_KINDS, [])

    return run


def _bound(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets that first meet with ra and rb elements left can be similar enough."""
    return np.minimum(ra, rb) * (100 + percent) >= percent * (na + nb)


def _pair_rows(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, shards: int) -> list[tuple]:
    """Distinct pairs, a < b, packed by shard of the pair."""
    swap = a > b
    a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)
    if not len(a):
        return []
    order = np.lexsort((b, a))
    a, b, na, nb = a[order], b[order], na[order], nb[order]
    first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] & (a != b)
    a, b, na, nb = a[first], b[first], na[first], nb[first]
    shard = (mix(a.view(np.uint64) ^ mix(b.view(np.uint64))) % np.uint64(shards)).astype(int)
    order = np.argsort(shard, kind="stable")
    used, start = np.unique(shard[order], return_index=True)
    return [(i, a[m].tobytes(), b[m].tobytes(), na[m].astype(np.int32).tobytes(), nb[m].astype(np.int32).tobytes()) for i, m in zip(used.tolist(), np.split(order, start[1:]), strict=True)]


_PAIRS = "pair_shard int, a binary, b binary, na binary, nb binary"
_PAIR_KINDS = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _runs(postings: DataFrame, percent: int, shards: int) -> DataFrame:
    """For each shingle of several classes: candidate pairs with the class of least place, and its entries if it has more than two."""

    def find(key, table):
        cols = table.to_pydict()
        sizes, counts = [np.frombuffer(x, np.int32) for x in cols["sizes"]], [_unpack(x, np.int32) for x in cols["counts"]]
        node = np.concatenate([np.repeat(np.frombuffer(x, np.int64), c) for x, c in zip(cols["nodes"], counts, strict=True)])
        n = np.concatenate([np.repeat(x, c) for x, c in zip(sizes, counts, strict=True)]).astype(np.int64)
        short, place = np.concatenate([np.frombuffer(x, np.uint32) for x in cols["keys"]]), np.concatenate([_unpack(x, np.int32) for x in cols["places"]]).astype(np.int64)
        order = np.argsort(short, kind="stable")
        again = np.zeros(len(short), bool)
        again[1:] = short[order][1:] == short[order][:-1]
        many = again.copy()
        many[:-1] |= again[1:]
        order = order[many]  # only shingles of several entries
        order = order[np.lexsort((node[order], place[order], short[order]))]
        short, node, n, place = short[order], node[order], n[order], place[order]
        pick = np.lexsort((place, node, short))
        fresh = np.ones(len(pick), bool)
        fresh[1:] = (short[pick][1:] != short[pick][:-1]) | (node[pick][1:] != node[pick][:-1])
        keep = np.zeros(len(pick), bool)
        keep[pick[fresh]] = True  # a class of copies from several tasks counts once
        short, node, n, place = short[keep], node[keep], n[keep], place[keep]
        start = np.flatnonzero(np.r_[True, short[1:] != short[:-1]]) if len(short) else np.zeros(0, np.int64)
        size = np.diff(np.r_[start, len(short)])
        lead = np.repeat(start, size)
        ok = _bound(n[lead] - place[lead], n - place, n[lead], n, percent) & (lead != np.arange(len(lead)))
        pairs = _pair_rows(node[lead][ok], node[ok], n[lead][ok], n[ok], shards)
        more = np.repeat(size > 2, size)
        run = (np.repeat(np.arange(len(start)), size) << 24 | key[0].as_py())[more]
        entries = (run, node[more], n[more], place[more], node[lead][more])
        rows = len(pairs)
        empty = pa.nulls
        table = {name: pa.array([p[i] for p in pairs], t) for i, (name, t) in enumerate(zip(("pair_shard", "a", "b", "na", "nb"), _PAIR_KINDS, strict=True))}
        one = pa.table({**table, **{x: empty(rows, pa.binary()) for x in ("run", "node", "n", "place", "lead")}})
        parts = [(e.tobytes()) for e in entries]
        two = pa.table({**{x.split()[0]: empty(1, t) for x, t in zip(_PAIRS.split(", "), _PAIR_KINDS, strict=True)}, **{x: pa.array([p], pa.binary()) for x, p in zip(("run", "node", "n", "place", "lead"), parts, strict=True)}})
        return pa.concat_tables([one, two]) if len(run) else one

    return postings.groupBy("shard").applyInArrow(find, _PAIRS + ", run binary, node binary, n binary, place binary, lead binary")


def _bloom_bits(nodes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and masks of the two bits of each class."""
    h = mix(nodes.view(np.uint64))
    at = np.r_[h >> np.uint64(64 - bits), mix(h) >> np.uint64(64 - bits)].astype(np.int64)
    return at >> 3, np.uint8(1) << (at & 7).astype(np.uint8)


def bloom_has(packed: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Whether each class may be in the bit map."""
    at, mask = _bloom_bits(nodes, (8 * len(packed)).bit_length() - 1)
    return (packed[at] & mask > 0).reshape(2, -1).all(axis=0)


#: Least and most bits (as powers of two) of a bit map, 16 a class between them: 32 MB at most are sent to an executor.
#: A fuller map excludes less; nothing is lost by that.
BLOOM_BITS = (20, 28)


def _bloom(pairs: DataFrame, classes: int) -> np.ndarray:
    """A bit map, of a size for so many, of all classes in pairs."""
    bits = min(max(BLOOM_BITS[0], (16 * classes).bit_length()), BLOOM_BITS[1])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros((1 << bits) // 8, np.uint8)
        for batch in batches:
            for c in ("a", "b"):
                for x in batch.column(c):
                    np.bitwise_or.at(packed, *_bloom_bits(np.frombuffer(x.as_buffer(), np.int64), bits))
        if packed.any():
            part = len(packed) // SLICES
            yield _batch("slice bits", [pa.int32(), pa.binary()], [(i, _pack(packed[i * part : (i + 1) * part])) for i in range(SLICES)])

    def merge(key, table):
        out = _unpack(table.column("bits")[0].as_py(), np.uint8).copy()
        for x in table.column("bits").to_pylist()[1:]:
            out |= _unpack(x, np.uint8)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([_pack(out)], pa.binary())})

    out = np.zeros((1 << bits) // 8, np.uint8)
    part = len(out) // SLICES
    # one job for all slices, which are 32 MB together at most
    for r in pairs.select("a", "b").mapInArrow(mark, "slice int, bits binary").groupBy("slice").applyInArrow(merge, "slice int, bits binary").collect():
        out[r.slice * part : (r.slice + 1) * part] = _unpack(bytes(r.bits), np.uint8)
    return out


def _segments(texts: DataFrame, k: int, key: bytes, fragments: int, bloom: np.ndarray) -> DataFrame:
    """The sets of candidate classes, cut at the fragments' bounds."""
    shared = texts.sparkSession.sparkContext.broadcast(bloom)
    cuts = np.array([(i << 64) // fragments for i in range(1, fragments)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, data, ends in read_blocks(batches):
            held, seen = [], set()
            for s in shingle_sets(data, ends, k, key):
                if len(s) and (node := node_of(s)) not in seen and bloom_has(shared.value, np.array([node], np.int64))[0]:
                    seen.add(node)
                    held.append((node, s, np.r_[0, np.searchsorted(s, cuts), len(s)]))
            rows = []
            nodes = np.array([x for x, _, _ in held], np.int64)
            for f in range(fragments):
                counts = np.array([e[f + 1] - e[f] for _, _, e in held], np.int32)
                some = counts > 0
                if some.any():
                    rows.append((f, nodes[some].tobytes(), counts[some].tobytes(), np.concatenate([g[e[f] : e[f + 1]] for _, g, e in held]).tobytes()))
            yield _batch("fragment nodes counts keys", [pa.int32()] + [pa.binary()] * 3, rows)

    return texts.mapInArrow(run, "fragment int, nodes binary, counts binary, keys binary")


def _narrowed(segments: DataFrame, bloom: np.ndarray) -> DataFrame:
    """The segments of the classes in a bit map."""
    shared = segments.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                nodes, counts, keys = (np.frombuffer(batch.column(x)[i].as_buffer(), t) for x, t in (("nodes", np.int64), ("counts", np.int32), ("keys", np.uint64)))
                some = bloom_has(shared.value, nodes)
                if some.any():
                    rows.append((batch.column("fragment")[i].as_py(), nodes[some].tobytes(), counts[some].tobytes(), keys[np.repeat(some, counts)].tobytes()))
            yield _batch("fragment nodes counts keys", [pa.int32()] + [pa.binary()] * 3, rows)

    return segments.mapInArrow(run, "fragment int, nodes binary, counts binary, keys binary")


def overlaps(nodes: np.ndarray, counts: np.ndarray, keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Size of the intersection of the segments of each pair; a class may be listed more than once, with the same segment."""
    listed, first = np.unique(nodes, return_index=True)
    start = (np.cumsum(counts) - counts)[first]
    size = counts[first].astype(np.int64)
    out = np.zeros(len(a), np.int64)
    ia, ib = np.searchsorted(listed, a), np.searchsorted(listed, b)
    there = (ia < len(listed)) & (ib < len(listed))
    there[there] = (listed[ia[there]] == a[there]) & (listed[ib[there]] == b[there])
    at = np.flatnonzero(there)
    if not len(at):
        return out
    ia, ib = ia[at], ib[at]
    swap = size[ia] < size[ib]
    ia, ib = np.where(swap, ib, ia), np.where(swap, ia, ib)  # the elements of the smaller are looked up
    _, rank = np.unique(keys, return_inverse=True)
    wide = int(rank.max()) + 1
    own = np.repeat(np.arange(len(listed)), size)
    places = np.arange(len(own)) + np.repeat(start - (np.cumsum(size) - size), size)
    table = own * wide + rank[places]  # sorted: classes in order, keys in order within each
    total = np.cumsum(size[ib])
    done = 0
    while done < len(at):
        to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + CHUNK, side="right")))
        n = size[ib[done:to]]
        pair = np.repeat(np.arange(done, to), n)
        each = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[ib[done:to]], n)
        want = ia[pair] * wide + rank[each]
        found = np.searchsorted(table, want)
        found[found == len(table)] = 0
        out[at[done:to]] = np.bincount(pair[table[found] == want] - done, minlength=to - done)
        done = to
    return out


def verify(pairs: DataFrame, segments: DataFrame, fragments: int, percent: int, shards: int) -> DataFrame:
    """(a, b) of the candidate pairs that are similar enough, from overlaps counted by fragment and summed."""

    def unique(key, table):
        c = {x: np.concatenate([np.frombuffer(y.as_buffer(), t) for y in table.column(x)]) for x, t in (("a", np.int64), ("b", np.int64), ("na", np.int32), ("nb", np.int32))}
        rows = _pair_rows(c["a"], c["b"], c["na"].astype(np.int64), c["nb"].astype(np.int64), shards)
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(("pair_shard", "a", "b", "na", "nb"), _PAIR_KINDS, strict=True))})

    distinct = written(pairs.groupBy("pair_shard").applyInArrow(unique, _PAIRS), "pairs")

    def count(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("pair_shard", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("overlap", pa.binary()))})
        nodes, counts, keys = (np.concatenate([np.frombuffer(y.as_buffer(), t) for y in left.column(x)]) for x, t in (("nodes", np.int64), ("counts", np.int32), ("keys", np.uint64)))
        a, b = [[np.frombuffer(y.as_buffer(), np.int64) for y in right.column(x)] for x in ("a", "b")]
        found = overlaps(nodes, counts, keys, np.concatenate(a), np.concatenate(b))
        rows, at = [], 0
        for shard, x, y in zip(right.column("pair_shard").to_pylist(), a, b, strict=True):
            part = found[at : at + len(x)]
            at += len(x)
            some = part > 0
            rows.append((shard, x[some].tobytes(), y[some].tobytes(), part[some].astype(np.int32).tobytes()))
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("pair_shard", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("overlap", pa.binary())))})

    spread = distinct.select("pair_shard", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))).alias("fragment"))
    partial = segments.groupBy("fragment").cogroup(spread.groupBy("fragment")).applyInArrow(count, "pair_shard int, a binary, b binary, overlap binary")

    def add(key, left, right):
        join = lambda t, x, k: np.concatenate([np.frombuffer(y.as_buffer(), k) for y in t.column(x)]) if t.num_rows else np.zeros(0, k)
        a, b, na, nb = (join(right, x, t) for x, t in (("a", np.int64), ("b", np.int64), ("na", np.int32), ("nb", np.int32)))
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], (na[order].astype(np.int64) + nb[order])
        pa_, pb, overlap = join(left, "a", np.int64), join(left, "b", np.int64), join(left, "overlap", np.int32)
        both = np.empty(len(a) + len(pa_), [("a", np.int64), ("b", np.int64)])
        both["a"], both["b"] = np.r_[a, pa_], np.r_[b, pb]
        distinct, at = np.unique(both, return_inverse=True)
        total = np.bincount(at[len(a) :], weights=overlap, minlength=len(distinct))[at[: len(a)]]
        linked = (100 + percent) * total >= percent * n
        return pa.table({"a": pa.array(a[linked], pa.int64()), "b": pa.array(b[linked], pa.int64())})

    return partial.groupBy("pair_shard").cogroup(distinct.groupBy("pair_shard")).applyInArrow(add, "a long, b long")


def _ties(rows: DataFrame, tied: Column) -> DataFrame:
    """(a, b) of the least class of each value of ``tied`` and every other class of that value, each pair once."""
    named = rows.where("node is not null").select(tied.alias("tie"), "node").where("tie is not null").distinct()
    least = named.groupBy("tie").agg(F.min("node").alias("a"))
    return named.join(least, "tie").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def _untied(pairs: DataFrame, ties: DataFrame, shards: int) -> DataFrame:
    """The distinct candidate pairs that are not tied already."""

    def deal_ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            none = np.zeros(len(a), np.int64)
            yield _batch("pair_shard a b na nb", _PAIR_KINDS, _pair_rows(a, b, none, none, shards))

    def minus(key, left, right):
        join = lambda t, x, k: np.concatenate([np.frombuffer(y.as_buffer(), k) for y in t.column(x)]) if t.num_rows else np.zeros(0, k)
        a, b, na, nb = (join(left, x, t) for x, t in (("a", np.int64), ("b", np.int64), ("na", np.int32), ("nb", np.int32)))
        given = np.zeros(len(a), bool)
        if right.num_rows and len(a):
            ta, tb = join(right, "a", np.int64), join(right, "b", np.int64)
            order = np.lexsort((np.r_[np.zeros(len(ta)), np.ones(len(a))], np.r_[tb, b], np.r_[ta, a]))  # ties stand before equal pairs
            is_tie = order < len(ta)
            last = np.maximum.accumulate(np.where(is_tie, np.arange(len(order)), -1))
            every_a, every_b = np.r_[ta, a][order], np.r_[tb, b][order]
            same = (last >= 0) & (every_a[last] == every_a) & (every_b[last] == every_b)
            given[order[~is_tie] - len(ta)] = same[~is_tie]
        rows = _pair_rows(a[~given], b[~given], na[~given].astype(np.int64), nb[~given].astype(np.int64), shards)
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(("pair_shard", "a", "b", "na", "nb"), _PAIR_KINDS, strict=True))})

    dealt = ties.mapInArrow(deal_ties, _PAIRS)
    return written(pairs.groupBy("pair_shard").cogroup(dealt.groupBy("pair_shard")).applyInArrow(minus, _PAIRS), "untied")


def _stars(rows: DataFrame, percent: int, turn: int, shards: int) -> DataFrame:
    """Pairs of each open entry with one class of its shingle."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, na, ra, b, nb, rb = (batch.column(x).to_numpy() for x in ("node", "n", "place", "p_node", "p_n", "p_place"))
            ok = _bound(na - ra, nb - rb, na, nb, percent)
            yield _batch("pair_shard a b na nb", _PAIR_KINDS, _pair_rows(a[ok], b[ok], na[ok], nb[ok], shards))

    return stars(rows, ["node", "n", "place"], turn).mapInArrow(pairs, _PAIRS)


def _remaining(rows: DataFrame, percent: int, shards: int) -> DataFrame:
    """All candidate pairs between open entries of one shingle that are in different components."""

    def cross(key, table):
        rows = []
        for c in each_tile(table, ["n", "place"]):
            n, rest = c["n"], c["n"] - c["place"]
            i, j = pairs_of_tile(c, lambda i, j, n=n, rest=rest: _bound(rest[i], rest[j], n[i], n[j], percent))
            rows += _pair_rows(c["node"][i], c["node"][j], n[i], n[j], shards)
        return pa.table({x: pa.array([r[i] for r in rows], t) for i, (x, t) in enumerate(zip(("pair_shard", "a", "b", "na", "nb"), _PAIR_KINDS, strict=True))})

    return deal(rows).groupBy("group").applyInArrow(cross, _PAIRS)


def classes_and_links(docs: DataFrame, k: int = K, percent: int = PERCENT, fragments: int | None = None, tied: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node) of every row, node null for empty sets, and (node, component) of linked classes.

    Classes of rows of one value of ``tied`` (over doc_id) are linked without a look at their sets.
    """
    spark = docs.sparkSession
    small_batches(spark)
    key = new_key()
    texts = text_blocks(docs)
    shards = shard_count(texts)
    # each step is written and its shuffles are swept before the next one begins: the shuffles of two never stand on disk at once
    classes = written(_ask(texts, k, key, shards).groupBy("shard").applyInArrow(_frequencies, "block long, shard int, classes binary"), "frequencies")
    sweep(spark)
    first = written(texts.groupBy("block").cogroup(classes.groupBy("block")).applyInArrow(_prefixes(k, key, percent, shards), _PREFIX_SCHEMA), "prefixes")
    drop(classes)
    rows = first.where("n is not null").select("doc_id", "n", "node")
    postings = first.where("shard is not null").select("shard", "nodes", "sizes", "counts", "keys", "places")
    found = written(_runs(postings, percent, shards), "runs")
    narrow = written(rows, "rows")
    drop(first)
    rows = narrow
    pairs = found.where("a is not null").select("pair_shard", "a", "b", "na", "nb")
    ties = None
    if tied is not None:
        ties = written(_ties(rows, tied), "ties")
        pairs = _untied(pairs, ties, shards)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(batch.column(x)[i].as_buffer(), np.int64)) for x in batch.schema.names], names=batch.schema.names)

    entries = found.where("run is not null").select("run", "node", "n", "place", "lead").mapInArrow(spell, "run long, node long, n long, place long, lead long")
    involved = pairs.select("a", "b").union(found.where("run is not null").select(F.col("node").alias("a"), F.col("node").alias("b")))
    n_rows, elements = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if fragments is None:
        fragments = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * elements // FRAGMENT_BYTES)
    segments = written(_segments(texts, k, key, fragments, _bloom(involved, n_rows)), "segments")
    drop(texts)
    links = written(verify(pairs, segments, fragments, percent, shards), "links")
    if ties is not None:
        links = links.union(ties)
    labels = components(links)
    rows_open = written(open_entries(entries, labels), "open")
    left, turn = rows_open.count(), 0
    while left:
        turn += 1
        more = written(_stars(rows_open, percent, turn, shards), "stars")
        links = links.union(written(verify(more, _narrowed(segments, _bloom(more, n_rows)), fragments, percent, shards), "links"))
        labels = components(links)
        last, rows_open = rows_open, written(open_entries(rows_open.drop("component"), labels), "open")
        drop(last, more)
        before, left = left, rows_open.count()
        if left > (1 - PROGRESS) * before:
            break
    if left:
        more = written(_remaining(rows_open, percent, shards), "remaining")
        links = links.union(written(verify(more, _narrowed(segments, _bloom(more, n_rows)), fragments, percent, shards), "links"))
        labels = components(links)
        drop(more)
    drop(rows_open, segments, found)
    return rows, labels


def join_components(docs: DataFrame, k: int = K, percent: int = PERCENT, fragments: int | None = None, tied: Column | None = None) -> DataFrame:
    """One row for each row of ``docs``: size of its set and the smallest doc_id that links reach.

    Null and empty texts have no shingles and are linked with nothing.  Equal sets are always
    linked.  A row with a null id has a set but no say in its component's id.  Shingles and sets are
    told apart by 64-bit hashes that are made of 128-bit digests of the words under a key drawn for the
    run: no text can be made to meet another, and N sets meet by chance with probability N * N / 2^65.
    Rows of one value of ``tied``, a column over doc_id, that have shingles are linked whatever their texts (null ties nothing).
    """
    with scratch() as kept:
        rows, labels = classes_and_links(docs, k, percent, fragments, tied)
        per = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
        per = written(per.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "classes")
        least = per.groupBy("component").agg(F.min("least").alias("component_id"))
        named = per.join(least, "component").select("node", "component_id")
        out = rows.join(named, "node", "left")
        return kept(written(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), "components"))
