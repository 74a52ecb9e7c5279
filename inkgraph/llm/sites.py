"""Quality classifier by hierarchical empirical Bayes.

A naive Bayes model over hashed words and shape features gives each document a
log-likelihood ratio for two labels, low quality and toxic.  Labelled documents
are summed by host and by path; a path's rate is shrunk towards its host's and
a host's towards the global one, with weights fitted to the spread between
hosts.  Evidence and path posterior are added as log-odds.

Texts are read four times and never shuffled.  The model is fitted on a bounded
sample of labelled rows (``train_rows``); label sums cover all of them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buffers import ALNUM_WORDS, ASCII_LOWER, SpanHash, blocks, joined_hash, mix, text_buffer, word_spans
from .storage import small_batches, written

LABELS = ("low_quality", "toxic")
#: Labelled rows that the model is fitted on at most, those with the least hash of their id.
TRAIN_ROWS = 60_000
BITS = 18
SLOTS = 1 << BITS
#: A feature counts if its two-by-two table with the label is so many standard errors from independence.
MIN_Z = 5.0
#: Least log-odds ratio of a feature, and the documents that it must be in: many weak features only tell long texts.
MIN_RATIO, MIN_DOCUMENTS = 2.0, 3
#: Orders under which least hashes are compared to tell near copies.
COPY_ORDERS = 4
#: Copies of each site's sums in the join, so that a hot site is dealt to as many tasks.
SALT = 16
#: Bins of the evidence on which it is calibrated, and their width.
BINS, WIDTH = 400, 0.25
SLICES = 16

_SHAPES = [("upper", range(65, 91)), ("digit", range(48, 58)), ("bang", b"!?"), ("symbol", b"#*$%&|<>"), ("stop", b".,;:"), ("high", range(128, 256))]
_EDGES = np.array([0.001, 0.01, 0.03, 0.06, 0.1, 0.15, 0.3])
_LENGTHS = np.array([5, 20, 50, 100, 300, 1000, 5000])
_SHAPE_SLOTS = 8 * (len(_SHAPES) + 3)


def _ranges(sums: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(sums) + 1, np.int64)
    np.cumsum(sums, out=total[1:])
    return total[ends[1:]] - total[ends[:-1]]


def document_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, feature slot and feature key; a pair may repeat.

    A word's key is its 64-bit hash, of which the slot is a part; the last slots are for shape and their own keys.
    """
    data, ends = text_buffer(column)
    rows = len(ends) - 1
    size = np.maximum(np.diff(ends), 1)
    lower = ASCII_LOWER[data]
    starts, stops, first = word_spans(lower, ends, ALNUM_WORDS)
    hashes = SpanHash(lower).spans(starts, stops)
    words = np.maximum(np.diff(first), 1)
    owner = np.repeat(np.arange(rows), np.diff(first))
    slots = (hashes % np.uint64(SLOTS - _SHAPE_SLOTS)).astype(np.int64)
    shapes = []
    for _, chars in _SHAPES:
        mask = np.zeros(256, bool)
        mask[list(chars)] = True
        shapes.append(np.searchsorted(_EDGES, _ranges(mask[data], ends) / size))
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    shapes.append(np.searchsorted(_EDGES, _ranges(same, first) / words))
    shapes.append(np.searchsorted(_LENGTHS, np.diff(first)))
    shapes.append(np.clip((size / words).astype(np.int64) - 3, 0, 7))
    base = SLOTS - _SHAPE_SLOTS
    extra = np.concatenate([base + 8 * i + s for i, s in enumerate(shapes)]) if rows else np.zeros(0, np.int64)
    return np.r_[owner, np.tile(np.arange(rows), len(shapes))], np.r_[slots, extra], np.r_[hashes, extra.astype(np.uint64)]


def _label_rows(labels: DataFrame) -> DataFrame:
    """One row for each labelled document; of several labels for an id the worst counts."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg((F.min("quality") == 0).cast("int").alias("low_quality"), (F.max("toxic") == 1).cast("int").alias("toxic"))


def _g_statistic(yes: np.ndarray, no: np.ndarray, bad: int, good: int) -> np.ndarray:
    """Likelihood-ratio statistic of each feature's two-by-two table; in squared standard errors."""
    with_, total = yes + no, bad + good
    out = np.zeros(len(yes))
    for seen, share in ((yes, with_ * bad), (no, with_ * good), (bad - yes, (total - with_) * bad), (good - no, (total - with_) * good)):
        out += 2 * seen * np.log(np.maximum(seen, 1) / np.maximum(share / total, 1e-300))
    return out


def _without_copies(docs: DataFrame, known: dict) -> list[int]:
    """The ids of a sample without near copies of smaller ids: else a text that was copied often would make its words features.

    A copy has the least hash of its word 3-grams, under one of a few orders, in common with an earlier text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(set(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            ids = batch.column("doc_id").to_pylist()
            at = [i for i, x in enumerate(ids) if x in shared.value]
            if not at:
                continue
            data, ends = text_buffer(batch.column("text").take(pa.array(at)))
            data = ASCII_LOWER[data]
            starts, stops, first = word_spans(data, ends, ALNUM_WORDS)
            grams = joined_hash(SpanHash(data).spans(starts, stops), 3)
            rows = [(ids[i], k, int(mix(grams[a : b - 2] ^ np.uint64(k * 0x9E3779B9)).min().view(np.int64))) for i, a, b in zip(at, first, first[1:], strict=False) if b - a > 2 for k in range(COPY_ORDERS)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "k", "least"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, k int, least long")
    first = rows.groupBy("k", "least").agg(F.min("doc_id").alias("first"), F.collect_set("doc_id").alias("ids")).where(F.size("ids") > 1)
    copies = {r.doc_id for r in first.select(F.explode("ids").alias("doc_id"), "first").where("doc_id <> first").select("doc_id").distinct().collect()}
    return [i for i in known if i not in copies]


def _significant(yes: np.ndarray, no: np.ndarray, bad: int, good: int) -> np.ndarray:
    return _g_statistic(yes, no, bad, good) >= MIN_Z**2


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model: whether a slot may hold a feature, the features' keys in order, and their weights for both labels.

    A first pass over the sample counts slots; a second counts the words themselves in slots that differ
    between the labels, so that rare words do not share the weight of a slot.
    """
    spark = docs.sparkSession
    sample = _label_rows(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).fillna(0)
    known = {r.doc_id: (r.low_quality, r.toxic) for r in sample.collect()}
    known = {i: known[i] for i in _without_copies(docs, known)}
    shared = spark.sparkContext.broadcast(known)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for batch in blocks(batches):
            ids = batch.column("doc_id").to_pylist()
            at = [i for i, x in enumerate(ids) if x in shared.value]
            if at:
                yield np.array([shared.value[ids[i]] for i in at]), *document_features(batch.column("text").take(pa.array(at)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, SLOTS), np.int32)  # documents, those of each label, and in [3] sizes
        for y, owner, slot, _ in labelled(batches):
            pairs = np.unique(owner * SLOTS + slot)
            owner, slot = pairs // SLOTS, pairs % SLOTS
            total[0] += np.bincount(slot, minlength=SLOTS).astype(np.int32)
            for k in range(2):
                total[1 + k] += np.bincount(slot[y[owner, k] == 1], minlength=SLOTS).astype(np.int32)
            total[3, :3] += [len(y), *y.sum(axis=0)]
        parts = [zlib.compress(np.ascontiguousarray(total[:, i :: SLICES]).tobytes(), 1) for i in range(SLICES)] if total[3, 0] else []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])

    def add(key, tables):
        total = sum(np.frombuffer(zlib.decompress(x), np.int32).astype(np.int64) for x in tables.column("counts").to_pylist())
        return pa.table({"slice": [key[0].as_py()], "counts": [zlib.compress(total.tobytes(), 1)]}, schema=pa.schema([("slice", pa.int32()), ("counts", pa.binary())]))

    rows = docs.select("doc_id", "text")
    summed = rows.mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary").collect()
    total = np.zeros((4, SLOTS), np.int64)
    for r in summed:
        total[:, r.slice :: SLICES] = np.frombuffer(zlib.decompress(bytes(r.counts)), np.int64).reshape(4, -1)
    sizes = total[3, :3]
    open_ = np.zeros(SLOTS, bool)
    for k in range(2):
        if 0 < sizes[1 + k] < sizes[0]:
            open_ |= _significant(total[1 + k], total[0] - total[1 + k], sizes[1 + k], sizes[0] - sizes[1 + k])
    slots = spark.sparkContext.broadcast(open_)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for y, owner, slot, key in labelled(batches):
            used = slots.value[slot]
            pairs = np.unique(np.rec.fromarrays([owner[used], key[used]], names="o,k"))
            keys, at = np.unique(pairs["k"], return_inverse=True)
            counts = [np.bincount(at, minlength=len(keys))] + [np.bincount(at[y[pairs["o"], k] == 1], minlength=len(keys)) for k in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(c.astype(np.int64)) for c in counts)], names=["key", "n", *LABELS])

    counted = rows.mapInArrow(words, "key long, n long, " + ", ".join(f"{x} long" for x in LABELS)).groupBy("key").agg(*[F.sum(x).alias(x) for x in ("n", *LABELS)])
    found = sorted((int(np.int64(r.key).view(np.uint64)), r.n, r.low_quality, r.toxic) for r in counted.where(F.col("n") >= MIN_DOCUMENTS).collect()) if open_.any() else []
    keys = np.array([r[0] for r in found], np.uint64)
    weights = np.zeros((2, len(keys)))
    n = np.array([r[1] for r in found], np.int64)
    for k in range(2):
        bad, good = sizes[1 + k], sizes[0] - sizes[1 + k]
        if not 0 < bad < sizes[0]:
            continue
        yes = np.array([r[2 + k] for r in found], np.int64)
        ratio = np.log((yes + 0.5) / (bad + 1)) - np.log((n - yes + 0.5) / (good + 1))
        weights[k] = np.where(_significant(yes, n - yes, bad, good) & (np.abs(ratio) >= MIN_RATIO), ratio, 0)
    some = (weights != 0).any(axis=0)
    return open_, keys[some], weights[:, some]


def evidence(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, host, path and the two log-likelihood ratios of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, keys, weights = shared.value
        for batch in blocks(batches):
            owner, slot, key = document_features(batch.column("text"))
            used = open_[slot]
            owner, key = owner[used], key[used]
            at = np.searchsorted(keys, key)
            at[at == len(keys)] = 0
            used = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            pairs = np.unique(owner[used] * max(len(keys), 1) + at[used])
            sums = [np.bincount(pairs // max(len(keys), 1), weights=w[pairs % max(len(keys), 1)], minlength=batch.num_rows).astype(np.float64) if len(keys) else np.zeros(batch.num_rows) for w in weights]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("host"), batch.column("path"), *map(pa.array, sums)], names=["doc_id", "host", "path", *(f"llr_{x}" for x in LABELS)])

    return docs.select("doc_id", "text", "host", "path").mapInArrow(run, "doc_id long, host string, path string, " + ", ".join(f"llr_{x} double" for x in LABELS))


def _calibrate(bins: list) -> tuple[float, float]:
    """Slope and intercept of a logistic fit of a label on the binned evidence, lightly regularised."""
    if not bins:
        return 1.0, 0.0
    x = np.array([(b - BINS / 2) * WIDTH for b, _, _ in bins])
    n, y = np.array([float(c) for _, c, _ in bins]), np.array([float(k) for _, _, k in bins])
    slope, intercept = 0.5, math.log((y.sum() + 1) / (n.sum() - y.sum() + 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + intercept, -30, 30)))
        w = n * p * (1 - p)
        grad = np.array([((y - n * p) * x).sum() - slope, (y - n * p).sum()])
        hess = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(hess, grad), -1, 1)
        slope, intercept = slope + move[0], intercept + move[1]
        if np.abs(move).max() < 1e-6:
            break
    return max(slope, 0.0), intercept


def _shrinkage(rows: DataFrame, group: list[str], label: str, mean: float) -> float:
    """Weight of the prior, in documents, by the method of moments over the groups' rates."""
    r = rows.groupBy(*group).agg(F.sum("n").alias("n"), F.sum(label).alias("k")).where("n > 0").agg(
        F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - mean, 2)).alias("spread")
    ).first()
    if not r.groups or r.groups < 2 or not 0 < mean < 1:
        return 1e6
    scale = r.n - r.nn / r.n
    between = max((r.spread - (r.groups - 1) * mean * (1 - mean)) / scale, 0.0) if scale > 0 else 0.0
    return min(max(mean * (1 - mean) / between - 1, 1.0), 1e6) if between > 0 else 1e6


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, train_rows: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """One row for each row of ``docs``: both probabilities, the rates of its site, and whether it is kept.

    ``host`` and ``path`` are expressions over ``docs``; null sites form one site of their own.  Null
    texts are empty.  A document's own label does not count in its site's rates.  Without labels all
    probabilities are one half of nothing known and every document is kept.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rows = written(evidence(docs, fit(docs, labels, train_rows)), "evidence")
    known = _label_rows(labels).fillna(0)
    rows = written(rows.join(known, "doc_id", "left"), "labelled")
    seen = rows.where("toxic is not null")
    sites = written(seen.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in LABELS]), "sites")
    total = sites.agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in LABELS]).first()
    n = total.n or 0
    hosts = sites.groupBy("host").agg(F.sum("n").alias("host_n"), *[F.sum(x).alias(f"host_{x}") for x in LABELS])
    salted = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    both = rows.select("host", "path").distinct().join(hosts, "host", "left").join(sites.select("host", "path", "n", *LABELS), ["host", "path"], "left").withColumnsRenamed({x: f"path_{x}" for x in LABELS}).select("*", salted)
    out = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).join(both, ["host", "path", "salt"], "left")
    own = F.col("toxic").isNotNull().cast("int")
    for label in LABELS:
        mean = ((total[label] or 0) + 0.5) / (n + 1)
        bin_ = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(F.col(f"llr_{label}") / WIDTH + BINS / 2 + 0.5))).cast("int")
        slope, intercept = _calibrate([tuple(r) for r in seen.groupBy(bin_.alias("b")).agg(F.count("*"), F.sum(label)).collect()])
        upper, lower = _shrinkage(sites, ["host"], label, mean), _shrinkage(sites, ["host", "path"], label, mean)
        mine = F.coalesce(F.col(label), F.lit(0))
        host_rate = (F.coalesce(f"host_{label}", F.lit(0)) - mine + upper * mean) / (F.coalesce("host_n", F.lit(0)) - own + upper)
        path_rate = (F.coalesce(f"path_{label}", F.lit(0)) - mine + lower * host_rate) / (F.coalesce("n", F.lit(0)) - own + lower)
        shift = _logit(path_rate) - math.log(mean / (1 - mean))
        odds = (slope * F.col(f"llr_{label}") + intercept + shift) if n else F.lit(math.log(mean / (1 - mean)) - 1)
        out = out.withColumns({f"host_rate_{label}": F.round(host_rate, 6), f"path_rate_{label}": F.round(path_rate, 6), f"p_{label}": F.round(1 / (1 + F.exp(-odds)), 6)})
    kept = F.lit(True)
    for label in LABELS:
        kept = kept & (F.col(f"p_{label}") <= threshold)
    return out.select("doc_id", *[f"p_{x}" for x in LABELS], *[f"host_rate_{x}" for x in LABELS], *[f"path_rate_{x}" for x in LABELS], kept.alias("kept"))
