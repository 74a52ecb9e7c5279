"""Language-model scoring with a probabilistic suffix tree.

Symbols are the bytes of lower-cased words, a separator after each word and an
end.  Contexts of up to ``DEPTH`` symbols are counted over all training texts
and kept where their next-symbol distribution diverges from that of the next
shorter context; a kept context keeps its suffixes.  Distributions are smoothed
towards the shorter context's, and each place of a text is scored in the state
of its longest kept suffix.

Beside it stands the add-one unigram score of the words.  Neither word counts nor
kept contexts are gathered in one place: each block of texts sends its distinct
words, by hash, and its distinct (context, next symbol) pairs to shards, which
send the totals of just these words and the logs of just these pairs back.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import ASCII_LOWER, SPACE_WORDS, blocks, digests, mix, new_key, text_buffer, word_spans
from .storage import drop, drop_part, scratch, small_batches, written

#: Longest context, in symbols.
DEPTH = 5
#: Contexts up to this length are looked up in a table of all of them, longer ones by search.
TABLE_DEPTH = 4
#: A context is kept if its count times its divergence (nats) from the shorter one is over GAIN.
GAIN = 20.0
#: Weight, in counts, of the shorter context's distribution.
PRIOR = 4.0
SHARDS = 64
#: Shards of kept contexts of two symbols and more, dealt by the last two.
STATE_SHARDS = 256
#: Text of a block whose distinct words are sent to the shards together.
SCORE_BYTES = 2 << 20

_BITS = 6
_SYMBOLS = 1 << _BITS
_SEP, _OTHER, _END = 0, 62, 63
_FREE = 61  # most frequent bytes with a symbol of their own
#: Hash that stands for the end token among word hashes.
_END_WORD = np.uint64(0x5EED0FE7D)


def is_training(doc_id: int | None) -> bool:
    """Whether a document is learned from; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2


def _training(column: pa.Array) -> np.ndarray:
    return np.array([is_training(x) for x in column.to_pylist()], bool)


def byte_counts(docs: DataFrame) -> np.ndarray:
    """How often each byte stands in the words of training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in blocks(batches):
            data, ends = text_buffer(batch.column("text"))
            total += np.bincount(ASCII_LOWER[data][np.repeat(_training(batch.column("doc_id")), np.diff(ends))], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(total, pa.int64())], names=["byte", "n"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(256, np.int64)
    for r in rows:
        out[r.byte] = r.n
    return np.where(SPACE_WORDS, out, 0)


def alphabet(counts: np.ndarray) -> np.ndarray:
    """Symbol of each byte: the most frequent get their own, the rest share one."""
    out = np.full(256, _OTHER, np.uint8)
    order = np.argsort(-counts, kind="stable")[:_FREE]
    order = order[counts[order] > 0]
    out[order] = np.arange(1, len(order) + 1)
    out[~SPACE_WORDS] = _SEP
    return out


def symbol_stream(data: np.ndarray, ends: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each word followed by one separator and each text by an end, and the ends' places."""
    inside = SPACE_WORDS[data]
    after = np.zeros(len(data) + 1, bool)
    after[1:] = inside
    cuts = ends[1:-1]
    after[cuts] = False
    keep = inside | (~inside & after[:-1])
    starts, stops, first = word_spans(data, ends, SPACE_WORDS)
    rows = len(ends) - 1
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    # a text that ends in a word has no byte for its last separator
    bare = np.zeros(rows, bool)
    full = np.diff(ends) > 0
    bare[full] = inside[ends[1:][full] - 1]
    sizes = kept[ends[1:]] - kept[ends[:-1]] + bare + 1
    last = np.cumsum(sizes)
    out = np.full(int(last[-1]) if rows else 0, _END, np.uint8)
    places = kept[:-1][keep] + np.repeat(last - sizes - kept[ends[:-1]], kept[ends[1:]] - kept[ends[:-1]])
    out[places] = symbols[data[keep]]
    out[last[bare] - 2] = _SEP
    return out, last - 1


def context_codes(stream: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """For each place the ``depth`` symbols before it as one number, nearest lowest; ends stand before a text."""
    n = len(stream)
    sizes = np.diff(np.r_[-1, ends])
    place = np.arange(n) - np.repeat(ends + 1 - sizes, sizes)
    out = np.zeros(n, np.int32 if depth * _BITS < 31 else np.int64)
    for k in range(1, depth + 1):
        near = np.full(n, _END, np.uint8)
        near[k:] = stream[:-k] if n > k else near[k:]
        near[place < k] = _END
        out |= near.astype(out.dtype) << (_BITS * (k - 1))
    return out


def _add(a: tuple[np.ndarray, np.ndarray] | None, b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if a is None:
        return b
    keys, at = np.unique(np.r_[a[0], b[0]], return_inverse=True)
    return keys, np.bincount(at, weights=np.r_[a[1], b[1]], minlength=len(keys)).astype(np.int64)


def _pack(*arrays: np.ndarray) -> list[bytes]:
    return [zlib.compress(x.tobytes(), 1) for x in arrays]


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def gram_counts(docs: DataFrame, symbols: np.ndarray, depth: int) -> DataFrame:
    """Counts of (context of full depth, next symbol) over training texts, by shard of the context's last symbol."""
    shared = docs.sparkSession.sparkContext.broadcast(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in blocks(batches):
            train = _training(batch.column("doc_id"))
            if not train.any():
                continue
            data, ends = text_buffer(batch.column("text").filter(pa.array(train)))
            stream, at = symbol_stream(ASCII_LOWER[data], ends, shared.value)
            grams = context_codes(stream, at, depth).astype(np.int64) << _BITS | stream
            grams.sort()
            first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
            total = _add(total, (grams[first], np.diff(np.append(first, len(grams)))))
        if total is not None:
            shard = (total[0] >> _BITS) % _SYMBOLS
            parts = [(s, *_pack(total[0][shard == s], total[1][shard == s])) for s in np.unique(shard).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in parts], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["shard", "grams", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "shard int, grams binary, counts binary")


def state_shard(codes: np.ndarray) -> np.ndarray:
    """Shard of contexts of two symbols and more."""
    return (mix((codes % _SYMBOLS**2).astype(np.uint64) + np.uint64(1)) % np.uint64(STATE_SHARDS)).astype(np.int32)


STATES = "shard int, depth int, code long, probs binary"


def kept_states(grams: DataFrame, depth: int = DEPTH, gain: float = GAIN, prior: float = PRIOR) -> tuple[np.ndarray, DataFrame]:
    """The root's distribution, and (shard, depth, code, distribution) of every context that passes the test."""
    grams = written(grams, "grams")

    def next_symbols(key, table):
        total = np.zeros(_SYMBOLS, np.int64)
        for g, c in zip(table.column("grams").to_pylist(), table.column("counts").to_pylist(), strict=True):
            total += np.bincount(_unpack(g, np.int64) % _SYMBOLS, weights=_unpack(c, np.int64), minlength=_SYMBOLS).astype(np.int64)
        return pa.table({"symbol": pa.array(np.arange(_SYMBOLS), pa.int32()), "n": pa.array(total, pa.int64())})

    root = np.zeros(_SYMBOLS)
    for r in grams.groupBy("shard").applyInArrow(next_symbols, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        root[r.symbol] = r.n
    root = (root + 0.5) / (root.sum() + 0.5 * _SYMBOLS)

    def grow(key, table):
        total = None
        for g, c in zip(table.column("grams").to_pylist(), table.column("counts").to_pylist(), strict=True):
            total = _add(total, (_unpack(g, np.int64), _unpack(c, np.int64)))
        # every level as sorted (context, symbol) pairs with counts; the level above has each pair's suffix
        last_pairs, last_probs = np.arange(_SYMBOLS), root
        levels = []
        for d in range(1, depth + 1):
            pairs, at = np.unique((total[0] >> _BITS) % _SYMBOLS**d << _BITS | total[0] % _SYMBOLS, return_inverse=True)
            counts = np.bincount(at, weights=total[1], minlength=len(pairs))
            codes, row = np.unique(pairs >> _BITS, return_inverse=True)
            n = np.bincount(row, weights=counts, minlength=len(codes))
            above = last_probs[np.searchsorted(last_pairs, (pairs >> _BITS) % _SYMBOLS ** (d - 1) << _BITS | pairs % _SYMBOLS)]
            divergence = np.bincount(row, weights=counts * np.log(counts / n[row] / above), minlength=len(codes))
            levels.append((codes, divergence, pairs, counts, row, n))
            last_pairs, last_probs = pairs, (counts + prior * above) / (n[row] + prior)
        for d in range(depth - 1, 0, -1):  # a kept context keeps its suffixes
            (codes, divergence, *_), (longer, gains, *_) = levels[d - 1], levels[d]
            np.maximum.at(divergence, np.searchsorted(codes, longer % _SYMBOLS**d), gains)
        out, up_codes, up_probs = [], np.zeros(1, np.int64), root[None, :]
        for d, (codes, divergence, pairs, counts, row, n) in enumerate(levels, 1):  # whole distributions for kept contexts alone
            kept = np.flatnonzero(divergence >= gain)
            place = np.full(len(codes), -1)
            place[kept] = np.arange(len(kept))
            dense = np.zeros((len(kept), _SYMBOLS))
            own = place[row] >= 0
            dense[place[row[own]], pairs[own] % _SYMBOLS] = counts[own]
            dense = (dense + prior * up_probs[np.searchsorted(up_codes, codes[kept] % _SYMBOLS ** (d - 1))]) / (n[kept, None] + prior)
            out += [(s, d, c, q.tobytes()) for s, c, q in zip(state_shard(codes[kept]).tolist(), codes[kept].tolist(), dense.astype(np.float32), strict=True)]
            up_codes, up_probs = codes[kept], dense
        return pa.table({n: pa.array([x[i] for x in out], t) for i, (n, t) in enumerate((("shard", pa.int32()), ("depth", pa.int32()), ("code", pa.int64()), ("probs", pa.binary())))})

    states = written(grams.groupBy("shard").applyInArrow(grow, STATES), "states")
    drop(grams)
    return root.astype(np.float32), states


def _rows(states: DataFrame) -> list:
    return [(r.depth, r.code, np.frombuffer(bytes(r.probs), np.float32)) for r in states.orderBy("depth", "code").collect()]


class Tree:
    """The suffix tree in one place, for small corpora: the state of every sequence of ``TABLE_DEPTH`` symbols, and lists of longer contexts."""

    def __init__(self, symbols: np.ndarray, root: np.ndarray, states: list, depth: int):
        self.symbols, self.depth = symbols, depth
        self.probs = np.vstack([root, *(p for _, _, p in states)]).astype(np.float32)
        self.contexts = [(d, c) for d, c, _ in states]
        self._table: np.ndarray | None = None

    def __getstate__(self):
        return {**self.__dict__, "_table": None}

    def _build(self) -> None:
        """Tables for lookups, once in each worker."""
        self._log = np.log10(self.probs)
        size = min(self.depth, TABLE_DEPTH)
        kind = np.uint16 if len(self.probs) < 65536 else np.int32
        table = np.zeros(_SYMBOLS**size, kind)
        d, c = np.array([x[0] for x in self.contexts], int), np.array([x[1] for x in self.contexts], np.int64)
        for k in range(1, size + 1):
            at = np.flatnonzero(d == k)
            table.reshape(-1, _SYMBOLS**k)[:, c[at]] = (at + 1).astype(kind)
        self._longer = []
        for k in range(size + 1, self.depth + 1):
            at, up = np.flatnonzero(d == k), np.flatnonzero(d == k - 1)
            at, up = at[np.argsort(c[at])], up[np.argsort(c[up])]
            grown = np.zeros(len(self.probs), bool)  # states that have a longer context
            grown[up[np.searchsorted(c[up], c[at] % _SYMBOLS ** (k - 1))] + 1] = True
            self._longer.append((grown, c[at], (at + 1).astype(kind)))
        self._table = table

    def states(self, codes: np.ndarray) -> np.ndarray:
        """State of each context: its longest kept suffix."""
        if self._table is None:
            self._build()
        size = min(self.depth, TABLE_DEPTH)
        out = self._table[codes & (_SYMBOLS**size - 1)]
        for k, (grown, keys, numbers) in enumerate(self._longer, size + 1):
            at = np.flatnonzero(grown[out])
            if not len(at):
                break
            want = codes[at] & (_SYMBOLS**k - 1)
            place = np.searchsorted(keys, want)
            place[place == len(keys)] = 0
            found = keys[place] == want
            out[at[found]] = numbers[place[found]]
        return out

    def score(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log10 probability of each text; a byte without a symbol of its own is one of its kind with equal chance."""
        stream, at = symbol_stream(data, ends, self.symbols)
        state = self.states(context_codes(stream, at, self.depth))
        each = self._log[state, stream].astype(np.float64)
        others = max(int((self.symbols[SPACE_WORDS] == _OTHER).sum()), 1)
        each[stream == _OTHER] -= math.log10(others)
        total = np.r_[0.0, np.cumsum(each)]
        return total[at + 1] - total[np.r_[0, at[:-1] + 1]] if len(at) else np.zeros(0)


def train(docs: DataFrame, depth: int = DEPTH, gain: float = GAIN, prior: float = PRIOR) -> Tree:
    symbols = alphabet(byte_counts(docs))
    root, states = kept_states(gram_counts(docs, symbols, depth), depth, gain, prior)
    return Tree(symbols, root, _rows(states), depth)


def _pack_planes(x: np.ndarray) -> bytes:
    """Numbers byte place by byte place, which compresses better than one after another."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _unpack_planes(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _words(data: np.ndarray, ends: np.ndarray, key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words under ``key`` and at last of the end token, and the number of each text's first word."""
    starts, stops, first = word_spans(data, ends, SPACE_WORDS)
    return np.append(digests(data, starts, stops, key)[:, 0], _END_WORD), first


def _grams(data: np.ndarray, ends: np.ndarray, symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The context and next symbol of every place as one number, and the texts' last places."""
    stream, at = symbol_stream(data, ends, symbols)
    return context_codes(stream, at, depth).astype(np.int64) << _BITS | stream, at


_SCORED = "kind int, block long, doc_ids array<long>, held_out array<boolean>, ends array<long>, data binary, words binary, counts binary, grams binary"


def _scored_blocks(docs: DataFrame, symbols: np.ndarray, depth: int, key: bytes) -> DataFrame:
    """Two rows for each block of texts: the texts (kind 0); the distinct words' hashes and training counts, and the distinct (context, next symbol) pairs (kind 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in blocks(batches, limit=SCORE_BYTES):
            data, ends = text_buffer(batch.column("text"))
            data = ASCII_LOWER[data]
            training = _training(batch.column("doc_id"))
            hashes, first = _words(data, ends, key)
            words, tokens = np.unique(hashes, return_inverse=True)
            counts = np.bincount(tokens[:-1][np.repeat(training, np.diff(first))], minlength=len(words))
            counts[tokens[-1]] += training.sum()
            columns = [
                pa.array([0, 1], pa.int32()),
                pa.array([block, block], pa.int64()),
                pa.array([batch.column("doc_id").cast(pa.int64()).to_pylist(), None], pa.list_(pa.int64())),
                pa.array([~training, None], pa.list_(pa.bool_())),
                pa.array([ends, None], pa.list_(pa.int64())),
                pa.array([zstandard.ZstdCompressor(level=3).compress(data.tobytes()), None], pa.binary()),
                pa.array([None, words.tobytes()], pa.binary()),
                pa.array([None, *_pack(counts.astype(np.int32))], pa.binary()),
                pa.array([None, _pack_planes(np.diff(np.unique(_grams(data, ends, shared.value, depth)[0]), prepend=0))], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _SCORED.split(", ")])
            block += 1

    return docs.select("doc_id", "text").mapInArrow(run, _SCORED)


_ASKED = "block long, shard int, grams binary"


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's distinct (context, next symbol) pairs to the shards of their contexts."""
    for batch in batches:
        for i in range(batch.num_rows):
            grams = np.cumsum(_unpack_planes(batch.column("grams")[i].as_py(), np.int64))
            shard = state_shard(grams >> _BITS)
            order = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[order], np.arange(STATE_SHARDS + 1))
            parts = [(s, _pack_planes(np.diff(grams[order[a:b]], prepend=0))) for s, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("block")[i].as_py()] * len(parts), pa.int64()), pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], names=["block", "shard", "grams"])


def _answers(asked: DataFrame, states: DataFrame, root: np.ndarray, depth: int) -> DataFrame:
    """(block, shard, logs): log10 of each asked symbol in the state of its context's longest kept suffix."""
    # the root and the contexts of one symbol, 65 at most, are known to every shard
    short = _rows(states.where("depth = 1"))
    top = np.vstack([root, *(p for _, _, p in short)]).astype(np.float32)
    first = np.zeros(_SYMBOLS, np.int64)
    first[[c for _, c, _ in short]] = np.arange(1, len(short) + 1)

    def answer(key, left, right):
        d, c = left.column("depth").to_numpy(), left.column("code").to_numpy()
        probs = np.frombuffer(b"".join(left.column("probs").to_pylist()), np.float32).reshape(-1, _SYMBOLS)
        log = np.log10(np.vstack([top, probs]))
        levels = []
        for k in range(2, depth + 1):
            at = np.flatnonzero(d == k)
            at = at[np.argsort(c[at])]
            levels.append((k, c[at], at + len(top)))
        out = []
        for data in right.column("grams"):
            grams = np.cumsum(_unpack_planes(data.as_py(), np.int64))
            state = first[(grams >> _BITS) % _SYMBOLS]
            live = np.flatnonzero(state)
            for k, keys, numbers in levels:  # a kept context keeps its suffixes
                if not len(live) or not len(keys):
                    break
                want = (grams[live] >> _BITS) % _SYMBOLS**k
                place = np.searchsorted(keys, want)
                place[place == len(keys)] = 0
                found = keys[place] == want
                live = live[found]
                state[live] = numbers[place[found]]
            out.append(_pack_planes(log[state, grams % _SYMBOLS]))
        return pa.table({"block": right.column("block"), "shard": right.column("shard"), "logs": pa.array(out, pa.binary())})

    return states.where("depth > 1").groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(answer, "block long, shard int, logs binary")


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's distinct words to the shards of their hashes."""
    for batch in batches:
        for i in range(batch.num_rows):
            words = np.frombuffer(batch.column("words")[i].as_buffer(), np.uint64)
            counts = _unpack(batch.column("counts")[i].as_py(), np.int32)
            bounds = np.searchsorted(words, np.arange(SHARDS, dtype=np.uint64) << np.uint64(58))
            bounds = np.append(bounds, len(words))
            parts = [(s, words[a:b].tobytes(), *_pack(counts[a:b])) for s, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("block")[i].as_py()] * len(parts), pa.int64()), pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary()), pa.array([p[2] for p in parts], pa.binary())], names=["block", "shard", "words", "counts"])


def _total(key, table):
    """Total counts of a shard's words, for each block those of its own words."""
    words = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("words")]
    distinct, at = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([_unpack(x.as_py(), np.int32) for x in table.column("counts")]), minlength=len(distinct)).astype(np.int64)
    parts = np.split(total[at], np.cumsum([len(w) for w in words])[:-1])
    n, v = int(total.sum()), int((total > 0).sum())
    rows = table.num_rows
    return pa.table({"block": table.column("block"), "shard": table.column("shard"), "totals": pa.array([_pack(p)[0] for p in parts], pa.binary()), "n": pa.array([n] * rows, pa.int64()), "v": pa.array([v] * rows, pa.int64())})


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, depth: int = DEPTH, gain: float = GAIN, prior: float = PRIOR) -> DataFrame:
    """One row for each row of ``docs`` with its unigram and tree scores (log10).

    A null text is empty: one end token.  Repeated rows count and are scored each time; an empty
    table gives an empty result.  Distinct words are told apart by 64 bits of
    digests under a key drawn for the run.  A byte without a
    symbol of its own is one of its kind with equal chance.
    """
    small_batches(docs.sparkSession)
    words_key = new_key()
    with scratch() as kept:
        symbols = alphabet(byte_counts(docs))
        root, states = kept_states(gram_counts(docs, symbols, depth), depth, gain, prior)
        scored = written(_scored_blocks(docs, symbols, depth, words_key), "scored", by="kind")
        questions = scored.where("kind = 1")
        answers = written(_answers(questions.select("block", "grams").mapInArrow(_ask, _ASKED), states, root, depth), "answers")
        drop(states)
        totals = written(questions.select("block", "words", "counts").mapInArrow(_deal, "block long, shard int, words binary, counts binary").groupBy("shard").applyInArrow(_total, "block long, shard int, totals binary, n long, v long"), "totals")
        size = totals.groupBy("shard").agg(F.max("n").alias("n"), F.max("v").alias("v")).agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
        n, v = size.n or 0, size.v or 0
        drop_part(scored, "kind", 1)
        share = math.log10(max(int((symbols[SPACE_WORDS] == _OTHER).sum()), 1))

        def finish(key, left, right):
            out = []
            for row in left.to_pylist():
                parts = sorted(zip(right.column("kind").to_pylist(), right.column("shard").to_pylist(), right.column("answer").to_pylist(), strict=True))
                counts = np.concatenate([_unpack(p, np.int64) for kind, _, p in parts if not kind])
                data, ends = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"]), np.uint8), np.array(row["ends"], np.int64)
                hashes, first = _words(data, ends, words_key)
                tokens = np.unique(hashes, return_inverse=True)[1]
                log = np.log10((counts + 1) / (n + v + 1))
                base = np.r_[0.0, np.cumsum(log[tokens[:-1]])]
                known = np.r_[0, np.cumsum(counts[tokens[:-1]] > 0)]
                grams, at = _grams(data, ends, symbols, depth)
                distinct, place = np.unique(grams, return_inverse=True)
                logs = np.empty(len(distinct))
                logs[np.argsort(state_shard(distinct >> _BITS), kind="stable")] = np.concatenate([_unpack_planes(p, np.float32) for kind, _, p in parts if kind])
                logs[distinct % _SYMBOLS == _OTHER] -= share
                total = np.r_[0.0, np.cumsum(logs[place])]
                out.append(pa.table({
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "held_out": pa.array(row["held_out"], pa.bool_()),
                    "n_tokens": pa.array(np.diff(first) + 1, pa.int64()),
                    "n_known": pa.array(known[first[1:]] - known[first[:-1]] + int(counts[tokens[-1]] > 0), pa.int64()),
                    "train_tokens": pa.array([n] * len(at), pa.int64()),
                    "base_score": pa.array(base[first[1:]] - base[first[:-1]] + log[tokens[-1]], pa.float64()),
                    "score": pa.array(total[at + 1] - total[np.r_[0, at[:-1] + 1]], pa.float64()),
                }))
            return pa.concat_tables(out) if out else pa.schema([(x.split()[0], pa.float64()) for x in SCHEMA.split(", ")]).empty_table()

        left = scored.where("kind = 0").select("block", "doc_ids", "held_out", "ends", "data")
        right = totals.select("block", F.lit(0).alias("kind"), "shard", F.col("totals").alias("answer")).union(answers.select("block", F.lit(1).alias("kind"), "shard", F.col("logs").alias("answer")))
        return kept(written(left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(finish, SCHEMA), "scores"))
