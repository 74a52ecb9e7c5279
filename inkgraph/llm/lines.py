"""Line dedup with a segment-partition edit join.

Lines of at least ``MIN_BYTES`` UTF-8 bytes take part; edits are of bytes, or of
code points where ``chars`` is set.  Shorter lines of ``exact`` bytes or more are
repeats where they are equal.  Of
two lines within ``EDITS`` edits, one cut into EDITS + 1 segments shares at
least one of them with the other, near the same place.  Each distinct line
therefore puts its segments into an index, keyed by length, segment number and
content, and probes the index for its own and slightly smaller lengths with
the substrings that can align with a segment.  Candidates are verified along a
band of diagonals, over all pairs of a batch at once.

Lines joined by links form clusters; each cluster keeps its first line in the
order of (doc_id, line number) and loses all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import SpanHash, blocks, digests, mix, new_key, runs, text_buffer
from .components import components
from .jaccard import _bloom, bloom_has
from .storage import drop, scratch, small_batches, written
from .tiles import PROGRESS, deal, each_tile, open_entries, pairs_of_tile, stars

EDITS, MIN_BYTES = 2, 20
#: Least shards of the index, and the bytes of text (as stored) whose signatures a shard gets at most, about.
SHARDS, SHARD_BYTES = 64, 16 << 20
#: Pairs whose histograms are compared at once.
CHUNK = 1 << 16
#: Symbols of pairs that are compared at once.
SYMBOLS = 1 << 18
#: Bins of the byte histogram that bounds the distance of two lines from below.
BINS = 32
#: Stands for a null id in the order of lines: after all others.
LAST = (1 << 63) - 1


def line_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text number and number in its text of every line."""
    breaks = np.flatnonzero(data == 10)
    rows = len(ends) - 1
    stops = np.sort(np.r_[breaks, ends[1:]], kind="stable")
    # the end of a text sorts after the line breaks inside it, and before one that opens the next text
    owner = np.searchsorted(ends[1:], breaks, side="right")
    order = np.lexsort((np.r_[np.zeros(len(breaks), np.int8), np.ones(rows, np.int8)], np.r_[owner, np.arange(rows)]))
    stops, owner = np.r_[breaks, ends[1:]][order], np.r_[owner, np.arange(rows)][order]
    fresh = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
    starts = np.empty_like(stops)
    starts[1:] = stops[:-1] + 1
    starts[fresh] = ends[:-1]
    at = np.arange(len(owner))
    return starts, stops, owner, at - np.maximum.accumulate(np.where(fresh, at, 0))


def characters(data: np.ndarray, *places: np.ndarray) -> tuple[np.ndarray, ...]:
    """One number for each code point, its UTF-8 bytes, and byte places as numbers of code points."""
    lead = (data & 0xC0) != 0x80
    if lead.all():
        return data, *places
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=before[1:])
    at = np.flatnonzero(lead)
    out = data[at].astype(np.uint32)
    size = np.diff(np.append(at, len(data)))
    for k in range(1, 4):
        more = size > k
        out[more] = out[more] << np.uint32(8) | data[at[more] + k]
    return out, *(before[x] for x in places)


def segment_bounds(length: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and size of each of the edits + 1 segments of lines of these lengths; the last ones are longer by one."""
    parts = edits + 1
    short, longer = length // parts, length % parts
    out, start = [], np.zeros_like(length)
    for i in range(parts):
        size = short + (i >= parts - longer)
        out.append((start, size))
        start = start + size
    return out


def signatures(hashes: SpanHash, starts: np.ndarray, lengths: np.ndarray, edits: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, line numbers and whether the key is an index entry (else a probe), for all lines at once."""
    keys, lines, index = [], [], []
    every = np.arange(len(starts))

    def put(length, i, at, size, rows, own):
        salt = mix(length.astype(np.uint64) * np.uint64(64) + np.uint64(i))
        keys.append(hashes.spans(starts[rows] + at, starts[rows] + at + size) ^ salt)
        lines.append(rows)
        index.append(np.full(len(rows), own))

    for delta in range(edits + 1):
        rows = every[lengths - delta >= max(least, edits + 1)]
        length = lengths[rows] - delta
        for i, (start, size) in enumerate(segment_bounds(length, edits)):
            for shift in range(-edits, edits + delta + 1):  # multi-match-aware places
                if abs(shift) > i or abs(shift - delta) > edits - i:
                    continue
                at = start + shift
                ok = (at >= 0) & (at + size <= lengths[rows])
                put(length[ok], i, at[ok], size[ok], rows[ok], delta == 0 and shift == 0)
    return np.concatenate(keys), np.concatenate(lines), np.concatenate(index)


def line_digests(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of each line's digest; the first one names it among candidates, both together stand for its content."""
    two = digests(data, starts, stops, key).view(np.int64)
    return np.ascontiguousarray(two[:, 0]), np.ascontiguousarray(two[:, 1])


_LINES = "kind int, doc_id long, text_hash long, line_no int, line long, tail long, shard int, keys binary, lines binary, flags binary"
_NAMES = [x.split()[0] for x in _LINES.split(", ")]
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _first_pass(docs: DataFrame, edits: int, least: int, exact: int, chars: bool, key: bytes, shards: int) -> DataFrame:
    """Every line of at least ``exact`` bytes by hash (kind 0), and the signatures of a task's distinct long enough lines by shard (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in blocks(batches):
            data, ends = text_buffer(batch.column("text"))
            starts, stops, owner, number = line_spans(data, ends)
            keep = stops - starts >= min(least, exact)
            starts, stops, owner, number = starts[keep], stops[keep], owner[keep], number[keep]
            hashes = SpanHash(data)
            line, tail = line_digests(data, starts, stops, key)
            n = len(line)
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column("doc_id").cast(pa.int64()).take(take), batch.column("text_hash").take(take), pa.array(number.astype(np.int32)), pa.array(line), pa.array(tail), *(pa.nulls(n, t) for t in _KINDS[6:])], names=_NAMES)
            long = np.flatnonzero(stops - starts >= least)
            distinct, at = np.unique(line[long], return_index=True)
            at = long[at]
            fresh = ~np.isin(distinct, seen)
            seen = np.union1d(seen, distinct) if len(seen) < 2_000_000 else distinct  # only spares repeated work
            at = at[fresh]
            if not len(at):
                continue
            if chars:
                symbols, begin, end = characters(data, starts[at], stops[at])
                keys, lines, index = signatures(hashes if symbols is data else SpanHash(symbols), begin, end - begin, edits, 0)
            else:
                keys, lines, index = signatures(hashes, starts[at], (stops - starts)[at], edits, least)
            shard = ((keys >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            names, short = line[at][lines], keys.astype(np.uint32)
            parts = [(i, order[a:b]) for i, a, b in runs(shard[order])]
            rows = [(1, None, None, None, None, None, i, short[x].tobytes(), names[x].tobytes(), np.packbits(index[x]).tobytes()) for i, x in parts]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_KINDS)], names=_NAMES)

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, _LINES)


def _candidates(rows: DataFrame) -> DataFrame:
    """Pairs of a key's least indexed line with all others of the key; the entries of keys with more than two lines."""

    def find(key, table):
        sizes = [len(x) // 4 for x in table.column("keys").to_pylist()]
        short = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("keys")])
        line = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("lines")])
        own = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8))[:n] for x, n in zip(table.column("flags"), sizes, strict=True)]).view(bool)
        order = np.argsort(short, kind="stable")
        again = np.zeros(len(short), bool)
        again[1:] = short[order][1:] == short[order][:-1]
        many = again.copy()
        many[:-1] |= again[1:]
        order = order[many]
        order = order[np.lexsort((~own[order], line[order], short[order]))]
        short, line, own = short[order], line[order], own[order]
        fresh = np.ones(len(short), bool)
        fresh[1:] = (short[1:] != short[:-1]) | (line[1:] != line[:-1])
        short, line, own = short[fresh], line[fresh], own[fresh]  # a line counts once, as indexed if it is
        order = np.lexsort((line, ~own, short))
        short, line, own = short[order], line[order], own[order]
        start = np.flatnonzero(np.r_[True, short[1:] != short[:-1]]) if len(short) else np.zeros(0, np.int64)
        size = np.diff(np.r_[start, len(short)])
        live = own[start] & (size > 1) if len(start) else np.zeros(0, bool)
        group = np.repeat(np.arange(len(start)), size)
        keep = live[group]
        lead = line[np.repeat(start, size)]
        a, b = np.minimum(lead, line)[keep], np.maximum(lead, line)[keep]
        pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0) if keep.any() else np.zeros((0, 2), np.int64)
        more = keep & (size > 2)[group]
        return pa.table({
            "a": pa.array([np.ascontiguousarray(pairs[:, 0]).tobytes()], pa.binary()),
            "b": pa.array([np.ascontiguousarray(pairs[:, 1]).tobytes()], pa.binary()),
            "run": pa.array([(group.astype(np.int64) << 24 | key[0].as_py())[more].tobytes()], pa.binary()),
            "node": pa.array([line[more].tobytes()], pa.binary()),
            "own": pa.array([own[more].astype(np.int64).tobytes()], pa.binary()),
            "lead": pa.array([lead[more].tobytes()], pa.binary()),
        })

    return rows.where("kind = 1").select("shard", "keys", "lines", "flags").groupBy("shard").applyInArrow(find, "a binary, b binary, run binary, node binary, own binary, lead binary")


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(batch.column(x)[i].as_buffer(), np.int64)) for x in batch.schema.names], names=batch.schema.names)


def histograms(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Histograms of lines' symbols over ``BINS`` bins, counts modulo 256."""
    sizes = stops - starts
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    return np.bincount(np.repeat(np.arange(len(starts)), sizes) * BINS + data[at] % BINS, minlength=len(starts) * BINS).astype(np.uint8).reshape(-1, BINS)


def _texts(docs: DataFrame, bloom: np.ndarray, least: int, chars: bool, key: bytes) -> DataFrame:
    """(line, content, histogram) of candidate lines, once for each task."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            data, ends = text_buffer(batch.column("text"))
            starts, stops, _, _ = line_spans(data, ends)
            keep = stops - starts >= least
            starts, stops = starts[keep], stops[keep]
            line, _ = line_digests(data, starts, stops, key)
            line, at = np.unique(line, return_index=True)
            there = bloom_has(shared.value, line)
            line, starts, stops = line[there], starts[at[there]], stops[at[there]]
            bins = histograms(*characters(data, starts, stops)) if chars else histograms(data, starts, stops)
            yield pa.RecordBatch.from_arrays([pa.array(line), pa.array([data[a:b].tobytes() for a, b in zip(starts, stops, strict=True)], pa.binary()), pa.array([x.tobytes() for x in bins], pa.binary())], names=["line", "content", "bins"])

    return docs.select("text").mapInArrow(run, "line long, content binary, bins binary").groupBy("line").agg(F.first("content").alias("content"), F.first("bins").alias("bins"))


def equal(pd: np.ndarray, p_at: np.ndarray, td: np.ndarray, t_at: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many symbols from each pair's places on are equal, at most ``most``; a few are compared first, then more of those still equal."""
    out, live, width = np.zeros(len(most), np.int64), np.flatnonzero(most > 0), 16
    while len(live):
        size = np.minimum(most[live] - out[live], width)
        got, ends, a = np.empty_like(size), np.cumsum(size), 0
        while a < len(live):  # a bounded number of symbols, or one pair, at once
            b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SYMBOLS, side="right")), a + 1)
            x, n = live[a:b], size[a:b]
            first = np.cumsum(n) - n
            at = np.arange(int(n.sum())) - np.repeat(first, n)
            unlike = pd[np.repeat(p_at[x] + out[x], n) + at] != td[np.repeat(t_at[x] + out[x], n) + at]
            got[a:b] = np.minimum.reduceat(np.where(unlike, at, np.repeat(n, n)), first)
            a = b
        out[live] += got
        live, width = live[(got == size) & (out[live] < most[live])], 8 * width
    return out


def within(p: pa.Array, t: pa.Array, edits: int, chars: bool = False) -> np.ndarray:
    """Whether each pair of byte strings is within ``edits`` edits, of bytes or of code points.

    With e errors, ``reach[k]`` is the furthest place i such that the first i symbols of ``p`` and the
    first i + k of ``t`` are within e edits.  An error more leads on from the diagonals beside, and equal
    symbols from there: of a band of 2 * edits + 1 diagonals those that the ends can still be reached from.
    """
    (pd, pe), (td, te) = (characters(*_bytes(x)) if chars else _bytes(x) for x in (p, t))
    out = np.zeros(len(p), bool)
    order = np.flatnonzero(np.abs(np.diff(pe) - np.diff(te)) <= edits)
    p_at, t_at, p_size, t_size = pe[:-1][order], te[:-1][order], np.diff(pe)[order], np.diff(te)[order]
    none, reach = -(1 << 40), {}
    for e in range(edits + 1):
        last, reach = reach, {}
        for k in range(-e, e + 1):
            before = [last[d] + step for d, step in ((k, 1), (k - 1, 0), (k + 1, 1)) if d in last]
            i = np.minimum(np.minimum(np.maximum.reduce(before) if before else 0, p_size), t_size - k)
            x = np.flatnonzero((i >= max(0, -k)) & (np.abs(t_size - p_size - k) <= edits - e))
            reach[k] = np.full(len(order), none)
            reach[k][x] = i[x] + equal(pd, p_at[x] + i[x], td, t_at[x] + i[x] + k, np.minimum(p_size, t_size - k)[x] - i[x])
        done = np.any([(t_size - p_size == k) & (r == p_size) for k, r in reach.items()], axis=0)
        out[order[done]] = True
        order, p_at, t_at, p_size, t_size = (x[~done] for x in (order, p_at, t_at, p_size, t_size))
        reach = {k: r[~done] for k, r in reach.items()}
    return out


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8)[: max(int(ends[-1]), 1)] if data is not None and data.size else np.zeros(1, np.uint8)), ends


def _verify(pairs: DataFrame, texts: DataFrame, edits: int, chars: bool) -> DataFrame:
    """(a, b) of the distinct pairs within ``edits`` edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array(within(batch.column("p"), batch.column("t"), edits, chars))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    content = texts.select("line", "content")
    both = pairs.join(content.withColumnsRenamed({"line": "a", "content": "p"}), "a").join(content.withColumnsRenamed({"line": "b", "content": "t"}), "b")
    return both.where(F.abs(F.octet_length("p") - F.octet_length("t")) <= (4 * edits if chars else edits)).select("a", "b", "p", "t").mapInArrow(run, "a long, b long")


def _stars(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs of each open entry with one line of its key; one of both is in the index."""
    near = stars(rows, ["node", "own"], turn, F.col("own") == 1)
    return near.select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")).distinct()


def _remaining(rows: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """All pairs of open entries of a key that are in different clusters and whose histograms are close enough."""
    rows = rows.join(texts.select(F.col("line").alias("node"), "bins"), "node")

    def cross(key, table):
        out = [np.zeros((0, 2), np.int64)]
        for c in each_tile(table, ["own", "bins"]):
            own = c["own"] == 1
            i, j = pairs_of_tile(c, lambda i, j, own=own: own[i] | own[j])
            bins = np.frombuffer(b"".join(c["bins"].tolist()), np.uint8).reshape(-1, BINS)
            for at in range(0, len(i), CHUNK):
                a, b = i[at : at + CHUNK], j[at : at + CHUNK]
                apart = bins[a] - bins[b]  # modulo 256, as the counts
                close = np.minimum(apart, -apart).sum(axis=1, dtype=np.int64) <= 2 * edits
                x, y = c["node"][a[close]], c["node"][b[close]]
                out.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
        pairs = np.concatenate(out)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return deal(rows).groupBy("group").applyInArrow(cross, "a long, b long").distinct()


def find_repeats(docs: DataFrame, edits: int = EDITS, least: int = MIN_BYTES, exact: int | None = None, chars: bool = False) -> DataFrame:
    """(doc_id, text_hash, lines) with the numbers of the lines that repeat an earlier one; ``docs`` has doc_id, text_hash, text."""
    spark = docs.sparkSession
    small_batches(spark)
    key = new_key()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES)
    rows = written(_first_pass(docs, edits, least, least if exact is None else exact, chars, key, shards), "lines")
    lines = rows.where("kind = 0").select("doc_id", "text_hash", "line_no", "line", "tail")
    found = written(_candidates(rows), "candidates")
    pairs = written(found.select("a", "b").mapInArrow(_spell, "a long, b long").distinct(), "pairs")
    entries = found.select("run", "node", "own", "lead").mapInArrow(_spell, "run long, node long, own long, lead long")
    texts = written(_texts(docs, _bloom(found.select("a", "b"), pairs.count()), least, chars, key), "content")
    links = written(_verify(pairs, texts, edits, chars), "links")
    labels = components(links)
    rest = written(open_entries(entries, labels), "open")
    left, turn = rest.count(), 0
    while left:
        turn += 1
        links = links.union(written(_verify(_stars(rest, turn), texts, edits, chars), "links"))
        labels = components(links)
        last, rest = rest, written(open_entries(rest.drop("component"), labels), "open")
        drop(last)
        before, left = left, rest.count()
        if left > (1 - PROGRESS) * before:
            break
    if left:
        links = links.union(written(_verify(_remaining(rest, texts, edits), texts, edits, chars), "links"))
        labels = components(links)
    drop(rest, texts, pairs, found)
    place = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "line_no")
    first = lines.groupBy("line", "tail").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    clusters = labels.join(first, F.col("node") == F.col("line")).groupBy("component").agg(F.min("first").alias("least"))
    named = labels.join(clusters, "component").select("node", "least")
    first = written(first.join(named, F.col("line") == F.col("node"), "left").where("n > 1 or least is not null").select("line", "tail", F.coalesce("least", "first").alias("least")), "first")
    repeats = lines.join(first, ["line", "tail"]).where(place != F.col("least"))
    return repeats.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line_no")).alias("lines"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, least: int = MIN_BYTES, exact: int | None = None, chars: bool = False) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and ``n_lines`` and ``n_removed`` added (in place of columns of these names).

    Null texts stay null with no lines.  Rows that repeat an id stand at the same place in the order,
    so equal ones keep or lose the same lines.  Null ids come last.  Lines of less than ``least`` bytes
    go if they repeat another exactly and have ``exact`` bytes (without it they stay); ``chars`` counts
    edits in code points.  Lines are equal if their 128-bit digests are, under a key drawn for the run;
    near lines are compared by their bytes.
    """
    rest = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    mark = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in rest))  # no column begins with so many
    doc, text_hash, numbers = f"{mark}doc", f"{mark}hash", f"{mark}lines"
    keyed = docs.select(*rest).withColumn(text_hash, F.xxhash64(F.coalesce("text", F.lit(""))))
    with scratch() as kept:
        repeats = kept(written(find_repeats(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text"), edits, least, exact, chars), "repeats"))
    repeats = repeats.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(f"{mark}key"), F.col("lines").alias(numbers))
    joined = keyed.join(repeats, keyed["doc_id"].eqNullSafe(F.col(doc)) & (F.col(text_hash) == F.col(f"{mark}key")), "left").drop(doc, f"{mark}key", text_hash)
    schema = docs.select(*rest).schema.add("n_lines", "long").add("n_removed", "long")
    at = rest.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            texts, counts, removed = [], [], []
            for text, lines in zip(batch.column("text").to_pylist(), batch.column(numbers).to_pylist(), strict=True):
                parts = [] if text is None else text.split("\n")
                counts.append(len(parts))
                removed.append(len(lines or ()))
                gone = set(lines or ())
                texts.append("\n".join(x for i, x in enumerate(parts) if i not in gone) if gone else text)
            columns = [batch.column(c) for c in rest]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=[*rest, "n_lines", "n_removed"])

    return joined.mapInArrow(run, schema)


def line_report(docs: DataFrame, edits: int = EDITS, least: int = MIN_BYTES) -> DataFrame:
    """doc_id, line counts and the digest of what is left of each row's text (null as empty); exact repeats of every line that is not empty go, edits are of code points."""
    out = dedup_lines(docs.select("doc_id", "text"), edits, least, exact=1, chars=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
