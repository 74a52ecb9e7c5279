"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document, as search engines do: each row of the
written table holds the postings of one block of documents, a sorted list of
terms and for each term its word positions in the block.  A frequent term is
thus spread over all rows and no task gathers one term of the corpus.

Every window of a benchmark item is listed under its rarest term, by documents
of the whole index.  A block of the index looks up its own terms in that list,
so only windows whose rarest term occurs are expanded; the places of the rarest
term are then intersected with the lists of the other terms, rarest first, each
shifted by the term's offset.  All windows of a block are worked on at once.

A benchmark whose windows take at most ``BROADCAST_BYTES`` is sent to all
executors.  A larger one is joined to the blocks by its windows' rarest terms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import ALNUM_WORDS, ASCII_LOWER, blocks, digests, distinct_spans, new_key, text_buffer, word_spans
from .storage import scratch, small_batches, written
from .text_blocks import pack_deltas, unpack_deltas

WINDOW = 10
#: Words within which the rarest terms of an item, by documents of the whole index, make a proximity match, and how
#: many terms (all of an item that has fewer).
SLOP, NEAR_TERMS = 30, 3
#: Text of one row of the index; its postings take about as much.
BLOCK = 512 << 10
#: Memory of the windows that are sent to all executors at most, by ``WINDOW_BYTES`` for each word of the benchmark
#: (measured as lists: 450 bytes a window); those of a larger benchmark are joined.
BROADCAST_BYTES, WINDOW_BYTES = 64 << 20, 450
#: Places of rarest terms that are intersected at once.
CHUNK = 1 << 18

INDEX = "block long, doc_ids array<long>, doc_words array<int>, terms binary, starts binary, positions binary"


def terms_of(column: pa.Array, key: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct terms (128-bit digests) of a string column, the term's number for each word, and the number of each text's first word (one more entry at the end)."""
    data, ends = text_buffer(column)
    data = ASCII_LOWER[data]
    starts, stops, first = word_spans(data, ends, ALNUM_WORDS)
    contents, number = distinct_spans(data, starts, stops)
    _, offsets, joined = contents.buffers()
    cuts = np.frombuffer(offsets, np.int64)[: len(contents) + 1]
    terms = digests(np.frombuffer(joined, np.uint8)[: cuts[-1]] if joined else data[:0], cuts[:-1], cuts[1:], key)
    order = np.lexsort((terms[:, 1], terms[:, 0]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return terms[order], rank[number], first


def build_index(docs: DataFrame, key: bytes) -> DataFrame:
    """Postings of all tokens of ``docs``: one row for each block of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in blocks(batches, limit=BLOCK):
            terms, number, first = terms_of(batch.column("text"), key)
            order = np.argsort(number.astype(np.uint16) if len(terms) <= 65536 else number, kind="stable")  # positions of a term stay in order
            starts = np.searchsorted(number[order], np.arange(len(terms) + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()),
                    pa.array([batch.column("doc_id").cast(pa.int64()).to_pylist()], pa.list_(pa.int64())),
                    pa.array([np.diff(first).astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([terms.tobytes()], pa.binary()),
                    pa.array([pack_deltas(starts)], pa.binary()),
                    pa.array([pack_deltas(order)], pa.binary()),
                ],
                names=["block", "doc_ids", "doc_words", "terms", "starts", "positions"],
            )
            block += 1

    return docs.select("doc_id", "text").mapInArrow(run, INDEX)


def look_up(listed: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted term (two columns) in a sorted list of distinct ones, -1 if it is not there."""
    if not len(listed):
        return np.full(len(wanted), -1, np.int64)
    at = np.searchsorted(listed[:, 0], wanted[:, 0])
    out = np.full(len(wanted), -1, np.int64)
    open_ = np.flatnonzero(at < len(listed))
    while len(open_):  # more than once only where first halves are equal
        place = at[open_]
        first = listed[place, 0] == wanted[open_, 0]
        same = first & (listed[place, 1] == wanted[open_, 1])
        out[open_[same]] = place[same]
        open_ = open_[first & ~same]
        at[open_] += 1
        open_ = open_[at[open_] < len(listed)]
    return out


class Postings:
    """The posting lists of one row of the index."""

    def __init__(self, terms: bytes, starts: bytes, positions: bytes, doc_words: np.ndarray):
        self.terms, self.starts = np.frombuffer(terms, np.uint64).reshape(-1, 2), unpack_deltas(starts)
        self.positions = unpack_deltas(positions)
        self.sizes = np.diff(self.starts)
        self.first = np.zeros(len(doc_words) + 1, np.int64)
        np.cumsum(doc_words, out=self.first[1:])
        self.term_at = np.empty(len(self.positions), np.int64)  # which list holds a place
        self.term_at[self.positions] = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, side="right") - 1

    def expand(self, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of ``terms``, place) of all postings of these terms, in parts of bounded size (or of one term)."""
        total, done = np.cumsum(self.sizes[terms]), 0
        while done < len(terms):
            to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + CHUNK, side="right")))
            size = self.sizes[terms[done:to]]
            row = np.repeat(np.arange(done, to), size)
            yield row, self.positions[np.repeat(self.starts[terms[done:to]] - (np.cumsum(size) - size), size) + np.arange(len(row))]
            done = to

    def phrases(self, terms: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, first place) where the terms of a row stand one after another in one document; ``terms`` is padded behind its length."""
        inside = np.arange(terms.shape[1]) < lengths[:, None]
        order = np.argsort(np.where(inside, self.sizes[terms], np.iinfo(np.int64).max), axis=1, kind="stable")
        rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row, place in self.expand(np.take_along_axis(terms, order[:, :1], 1)[:, 0]):
            place = place - order[row, 0]
            ok = (place >= 0) & (place + lengths[row] <= len(self.term_at))
            row, place = row[ok], place[ok]
            for k in range(1, terms.shape[1]):  # the places that the shifted list of the next rarest term holds too
                ok = (k >= lengths[row]) | (self.term_at[np.minimum(place + order[row, k], len(self.term_at) - 1)] == terms[row, order[row, k]])
                row, place = row[ok], place[ok]
            ok = self.doc_of(place) == self.doc_of(place + lengths[row] - 1)
            rows.append(row[ok])
            places.append(place[ok])
        return np.concatenate(rows), np.concatenate(places)

    def near(self, terms: np.ndarray, lengths: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, document) where the second and further terms of a row occur within ``slop`` words of the first, the rarest."""
        wide = len(self.positions) + 1
        keys = np.repeat(np.arange(len(self.sizes)), self.sizes) * wide + self.positions  # sorted
        rows, docs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row, place in self.expand(terms[:, 0]):
            doc = self.doc_of(place)
            for k in range(1, terms.shape[1]):
                low, high = np.maximum(place - slop, self.first[doc]), np.minimum(place + slop, self.first[doc + 1] - 1)
                term = terms[row, k] * wide
                ok = (k >= lengths[row]) | (np.searchsorted(keys, term + high, side="right") > np.searchsorted(keys, term + low))
                row, place, doc = row[ok], place[ok], doc[ok]
            pair = np.unique(row * len(self.first) + doc)
            rows.append(pair // len(self.first))
            docs.append(pair % len(self.first))
        return np.concatenate(rows), np.concatenate(docs)


def _postings(batch: pa.RecordBatch) -> Iterator[tuple[int, Postings]]:
    for i in range(batch.num_rows):
        row = {name: batch.column(name)[i] for name in ("doc_words", "terms", "starts", "positions")}
        yield batch.column("block")[i].as_py(), Postings(*(row[k].as_buffer() for k in ("terms", "starts", "positions")), row["doc_words"].values.to_numpy())





class Queries:
    """Windows and proximity terms of items, listed by their rarest term."""

    def __init__(self, items: list[str], terms: list[bytes], width: int):
        """``terms``: digests of each row's terms in order, at most ``width``."""
        self.items, self.width = items, max(width, 1)
        self.lengths = np.array([len(t) // 16 for t in terms], np.int64)
        every = np.frombuffer(b"".join(terms), np.uint64).reshape(-1, 2)
        self.terms, number = _distinct(every)
        self.rows = np.zeros((len(terms), self.width), np.int64)
        inside = np.arange(self.width) < self.lengths[:, None]
        self.rows[inside] = number

    def list_by(self, rarest: np.ndarray) -> None:
        """``rarest``: for each row the place of its rarest term in the row."""
        lead = self.rows[np.arange(len(self.rows)), rarest]
        self.order = np.argsort(lead, kind="stable")
        self.cuts = np.searchsorted(lead[self.order], np.arange(len(self.terms) + 1))

    def expanded(self, p: Postings) -> tuple[np.ndarray, np.ndarray]:
        """The rows whose terms all occur in ``p``, and their terms' numbers there."""
        at = look_up(self.terms, p.terms)
        mine = np.flatnonzero(at >= 0)
        at = at[mine]
        here = np.full(len(self.terms), -1, np.int64)
        here[at] = mine
        size = self.cuts[at + 1] - self.cuts[at]
        rows = self.order[np.repeat(self.cuts[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        terms = here[self.rows[rows]]
        ok = ((terms >= 0) | (np.arange(self.width) >= self.lengths[rows, None])).all(axis=1)
        return rows[ok], np.maximum(terms[ok], 0)


def _distinct(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct terms, and the number of each."""
    if not len(terms):
        return terms, np.zeros(0, np.int64)
    order = np.lexsort((terms[:, 1], terms[:, 0]))
    ordered = terms[order]
    new = np.r_[True, (ordered[1:] != ordered[:-1]).any(axis=1)]
    number = np.empty(len(terms), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], number


MATCHES = "block long, at int, n_hit long, starts array<int>, stops array<int>, items array<string>, near_items array<string>"
_MATCH_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string())]
_MATCH_NAMES = [x.split()[0] for x in MATCHES.split(", ")]


def search(p: Postings, windows: Queries, near: Queries, slop: int) -> Iterator[tuple[int, int, list, list, list, list]]:
    """For each document with a match: its number, hit words, starts and ends of hit runs, items, items by proximity."""
    rows, terms = windows.expanded(p)
    lengths = windows.lengths[rows]
    row, place = p.phrases(terms, lengths)
    change = np.bincount(place, minlength=len(p.term_at) + 1) - np.bincount(place + lengths[row], minlength=len(p.term_at) + 1)
    hit = np.cumsum(change[:-1]) > 0
    edge = np.zeros(len(hit) + 1, np.int8)
    edge[:-1] = hit
    edge[1:] -= hit
    cuts = p.first[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(hit))]
    cuts = np.unique(cuts[hit[cuts] & hit[cuts - 1]])  # runs end with their document
    starts, stops = np.sort(np.r_[np.flatnonzero(edge == 1), cuts]), np.sort(np.r_[np.flatnonzero(edge == -1), cuts])
    owner = p.doc_of(starts)
    items: dict[int, set] = {}
    for doc, r in np.unique(np.stack([p.doc_of(place), rows[row]], 1), axis=0).tolist():
        items.setdefault(doc, set()).add(windows.items[r])
    found: dict[int, set] = {}
    rows, terms = near.expanded(p)
    for r, doc in zip(*p.near(terms, near.lengths[rows], slop), strict=True):
        found.setdefault(int(doc), set()).add(near.items[rows[r]])
    for doc in sorted(items.keys() | found.keys()):
        a, b = np.searchsorted(owner, [doc, doc + 1])
        x, y = starts[a:b] - p.first[doc], stops[a:b] - p.first[doc]
        yield doc, int((y - x).sum()), x.tolist(), y.tolist(), sorted(items.get(doc, ())), sorted(found.get(doc, ()))


def _rows_of(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(_MATCH_KINDS)], names=_MATCH_NAMES)


def _items(benchmark: DataFrame, key: bytes) -> DataFrame:
    """(item, terms, words): an item's distinct terms and the number of the term of each of its words, without items that have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, limit=BLOCK):
            terms, number, first = terms_of(batch.column("text"), key)
            out = []
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                if b > a:
                    used, own = np.unique(number[a:b], return_inverse=True)
                    out.append((batch.column("item")[i].as_py(), terms[used].tobytes(), own.astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.binary(), pa.binary()))], names=["item", "terms", "words"])

    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    return named.mapInArrow(run, "item string, terms binary, words binary")


def _queries_of(item: str, terms: np.ndarray, words: np.ndarray, counts: np.ndarray, window: int, near_terms: int) -> Iterator[tuple[bool, str, bytes, int]]:
    """(near, item, digests, place of the rarest term) of an item's windows and of its rarest terms, by documents of the whole index; none for terms that never occur."""
    n = min(window, len(words))
    rows = np.lib.stride_tricks.sliding_window_view(words, n)
    rows = np.unique(rows[(counts[rows] > 0).all(axis=1)], axis=0)
    for row, rarest in zip(rows, counts[rows].argmin(axis=1).tolist() if len(rows) else (), strict=True):
        yield False, item, terms[row].tobytes(), rarest
    there = np.flatnonzero(counts > 0)
    need = min(near_terms, len(counts))
    if need and len(there) >= need:
        yield True, item, terms[there[np.argsort(counts[there], kind="stable")[:need]]].tobytes(), 0


def _doc_counts(p: Postings, lists: np.ndarray) -> np.ndarray:
    """In how many documents of a row of the index each of these terms stands."""
    sizes = p.sizes[lists]
    row = np.repeat(np.arange(len(lists)), sizes)
    doc = p.doc_of(p.positions[np.repeat(p.starts[lists] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(row))])
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (doc[1:] != doc[:-1])  # positions of a term stay in order
    return np.bincount(row[first], minlength=len(lists))


def _small_search(index: DataFrame, items: list, window: int, slop: int, near_terms: int) -> DataFrame:
    """Matches in every row of the index; ``items`` are of a checked size and are sent to all executors."""
    context = index.sparkSession.sparkContext
    terms, number = _distinct(np.frombuffer(b"".join(r.terms for r in items), np.uint64).reshape(-1, 2))
    listed = context.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(listed.value), np.int64)
        for batch in batches:
            for _, p in _postings(batch):
                at = look_up(listed.value, p.terms)
                mine = np.flatnonzero(at >= 0)
                total[at[mine]] += _doc_counts(p, mine)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], names=["term", "n"])

    counts = np.zeros(len(terms), np.int64)
    for r in index.select("block", "doc_words", "terms", "starts", "positions").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        counts[r.term] = r.n
    cuts = np.r_[0, np.cumsum([len(r.terms) // 16 for r in items])]
    made: tuple[list, list] = ([], [])
    for r, a, b in zip(items, cuts, cuts[1:], strict=False):
        for near, *row in _queries_of(r.item, terms[number[a:b]], np.frombuffer(r.words, np.int32), counts[number[a:b]], window, near_terms):
            made[near].append(row)
    shared = context.broadcast(tuple(_listed(rows, width) for rows, width in zip(made, (window, near_terms), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, p in _postings(batch):
                found = [(block, *x) for x in search(p, *shared.value, slop)]
                if found:
                    yield _rows_of(found)

    return index.select("block", "doc_words", "terms", "starts", "positions").mapInArrow(run, MATCHES)


def _listed(rows: list, width: int) -> Queries:
    out = Queries([r[0] for r in rows], [bytes(r[1]) for r in rows], width)
    out.list_by(np.array([r[2] for r in rows], np.int64))
    return out


def _binary16(terms: np.ndarray) -> pa.Array:
    offsets = pa.py_buffer(np.arange(0, 16 * len(terms) + 1, 16, dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), len(terms), [None, offsets, pa.py_buffer(np.ascontiguousarray(terms))])


def _large_search(index: DataFrame, items: DataFrame, window: int, slop: int, near_terms: int) -> DataFrame:
    """The same by joins on terms: nothing of the benchmark is gathered in one place, and no task has more of the index than its blocks.

    Numbers of documents are summed within tasks before they are shuffled, so a word of every block is a row
    for each task.  Blocks meet only windows whose rarest term they have; Spark splits a term that is still frequent.
    """
    columns = ["block", "doc_words", "terms", "starts", "positions"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The terms of a block with their numbers of documents."""
        for batch in batches:
            for block, p in _postings(batch):
                n = _doc_counts(p, np.arange(len(p.terms)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), block, np.int64)), _binary16(p.terms), pa.array(n.astype(np.int64))], names=["block", "term", "n"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The terms of an item with their places."""
        for batch in batches:
            for i in range(batch.num_rows):
                terms = np.frombuffer(batch.column("terms")[i].as_buffer(), np.uint64).reshape(-1, 2)
                number = np.full(len(terms), batch.column("number")[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(np.arange(len(terms), dtype=np.int32)), _binary16(terms)], names=["number", "place", "term"])

    spreading = index.select(*columns).mapInArrow(spread, "block long, term binary, n long")
    asking = items.select("number", "terms").mapInArrow(asked, "number long, place int, term binary")
    totals = spreading.groupBy("term").agg(F.sum("n").alias("n"))
    counts = asking.join(totals, "term").select("number", "place", "n")

    def make(key, left, right):
        """An item's windows with their rarest terms."""
        rows = []
        places, found = (right.column(x).to_numpy() for x in ("place", "n"))
        for item, terms, words in zip(*(left.column(x).to_pylist() for x in ("item", "terms", "words")), strict=True):
            terms = np.frombuffer(terms, np.uint64).reshape(-1, 2)
            n = np.zeros(len(terms), np.int64)
            n[places] = found
            for near, name, digest, rarest in _queries_of(item, terms, np.frombuffer(words, np.int32), n, window, near_terms):
                rows.append((digest[16 * rarest : 16 * rarest + 16], near, name, digest, rarest))
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("term", pa.binary()), ("near", pa.bool_()), ("item", pa.string()), ("terms", pa.binary()), ("rarest", pa.int32())))})

    queries = written(items.groupBy("number").cogroup(counts.groupBy("number")).applyInArrow(make, "term binary, near boolean, item string, terms binary, rarest int"), "queries")
    sent = spreading.select("block", "term").join(queries, "term").select("block", "near", "item", "terms", "rarest")

    def finish(key, left, right):
        rows = list(zip(*(right.column(x).to_pylist() for x in ("near", "item", "terms", "rarest")), strict=True))
        both = [_listed([r[1:] for r in rows if r[0] is kind], width) for kind, width in ((False, window), (True, near_terms))]
        found = [(block, *x) for batch in left.to_batches() for block, p in _postings(batch) for x in search(p, *both, slop)] if rows else []
        return pa.Table.from_batches([_rows_of(found)])

    return index.select(*columns).groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(finish, MATCHES)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP, near_terms: int = NEAR_TERMS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each row of ``docs``: words, hit words, items found and whether any was.

    Null texts have no words; items without words match nothing; a null item id is listed as
    ``null`` and repeated items as one.  Repeated documents are judged alike; an empty corpus or
    benchmark gives no hits.  ``spans`` and ``near_items`` (items whose rarest terms stand close
    together) are there besides the counts.  Words are told apart by 128-bit digests under a key
    drawn for the run.  A benchmark whose windows take more than ``broadcast_bytes`` is joined, not broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    key = new_key()
    with scratch() as kept:
        index = written(build_index(docs, key), "postings")
        rows = index.select("block", F.posexplode(F.arrays_zip("doc_ids", "doc_words")).alias("at", "d")).select("block", "at", F.col("d.doc_ids").alias("doc_id"), F.col("d.doc_words").cast("long").alias("n_words"))
        items = written(_items(benchmark, key).withColumn("number", F.monotonically_increasing_id()), "items")
        words = (items.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // 4
        if words * WINDOW_BYTES <= broadcast_bytes:
            found = _small_search(index, items.drop("number").collect(), window, slop, near_terms)
        else:
            found = _large_search(index, items, window, slop, near_terms)
        matches = written(found.repartition("block"), "matches")
        none = F.array().cast("array<string>")
        out = rows.join(matches, ["block", "at"], "left").select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.array_join(F.sort_array(F.coalesce("items", none)), ","), 256).alias("items_sha256"),
            F.coalesce("near_items", none).alias("near_items"),
            F.arrays_zip("starts", "stops").alias("spans"),
        )
        return kept(written(out.withColumn("contaminated", F.col("n_hit") > 0), "verdicts"))
