"""A stored search index: tables by term that a query reads its buckets of, kept up to date by segments.

An index is a folder of segments, each a set of Parquet tables over some pages:

* ``postings`` (bucket, term, field, doc, tf, dl, places): where a word stands in a field of a page, and the
  field's length; a folder for each bucket of terms, sorted by term; stored as packs of a word of a field in many pages
* ``keys`` (bucket, key, doc, kind) titles and aliases; ``grams`` (bucket, gram, doc) runs of one to three
  characters of paths, and ``gram_counts`` how many paths have each
* ``names`` (part, doc, path_rel, title, row_hash, lengths) and ``pages`` (doc, the other columns), sorted by doc

and a manifest for each version: a small JSON file with the segments, the
tables of their deleted pages, and the sums that ranking needs.  An update
writes a segment of the pages that are new or changed and marks their old
versions and deleted pages dead; then the manifest of the next version appears
at once, by a rename that fails if another update came first.  Segments of
like size are merged when there are several; words are not cut again for that.

Readers of a version are not disturbed by later ones until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.query import Query, parse_query, words_of
from ..sources.tables import written
from . import search

FIELDS = list(search.WEIGHTS)
#: Bytes of text for one bucket of terms, and the least and the most buckets.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 64 << 20, 8, 4096
#: Pages over which one term's postings are written by one task.
SPREAD_PAGES = 200_000
#: Pages of a part of ``names``, as a power of two; numbers of a segment's pages, likewise.
PART_BITS, PAGE_BITS = 20, 40
#: Segments of one tier that are merged, and by which factor tiers differ in size.
MERGE, TIER = 4, 4
#: Length of path grams.
GRAM = 3
#: Pages that a task inverts at once.
INVERTED_PAGES = 2000

SCHEMAS = {
    "postings": "term string, field string, doc long, tf int, dl int, places array<int>, bucket int",
    "keys": "key string, doc long, kind int, bucket int",
    "grams": "gram string, doc long, bucket int",
    "gram_counts": "gram string, n long, bucket int",
    "names": "doc long, path_rel string, title string, row_hash string, lengths array<int>, part long",
    "pages": "doc long, path_rel string, summary string, aliases array<string>, tags array<string>, keywords array<string>, content string",
    "dead": "doc long",
}
COLUMNS = ["path_rel", "title", "summary", "aliases", "tags", "keywords", "body", "content"]


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def row_hash() -> Column:
    """Of everything that the index has of a page; lengths keep fields apart."""
    fields = [search.field_text(c) for c in COLUMNS]
    return F.sha2(F.concat(*[F.concat(F.length(F.coalesce(c, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(c, F.lit(""))) for c in fields]), 256)


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    version: int
    buckets: int
    segments: tuple[dict, ...]

    # Tables of all live pages.

    def read(self, kind: str, segments: Iterable[dict] | None = None, only: Column | None = None) -> DataFrame:
        """A table of all segments, with dead pages; the rows that ``only`` takes, by bucket and by term, key or gram."""
        return self._union(kind, [f"{s['name']}/{kind}" for s in (self.segments if segments is None else segments)], only)

    def _union(self, kind: str, parts: list[str], only: Column | None = None) -> DataFrame:
        """Folders have partitions of their own, so each is read as a table; compaction keeps them few.  Packs that ``only`` takes are spelled out."""
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[kind])
        rows = reduce(DataFrame.union, [self.spark.read.schema(PACKS if kind == "postings" else SCHEMAS[kind]).parquet(f"{self.path}/{p}") for p in parts])
        rows = rows if only is None else rows.where(only)
        return rows.mapInArrow(_spelled, SCHEMAS[kind]) if kind == "postings" else rows

    def dead(self, segments: Iterable[dict] | None = None) -> DataFrame | None:
        parts = [d for s in (self.segments if segments is None else segments) for d in s["dead"]]
        return self._union("dead", parts) if parts else None

    def live(self, rows: DataFrame, segments: Iterable[dict] | None = None) -> DataFrame:
        dead = self.dead(segments)
        return rows if dead is None else rows.join(dead, "doc", "left_anti")

    def names(self) -> DataFrame:
        return self.live(self.read("names"))

    def listed(self, kind: str, column: str, values: Iterable[str]) -> DataFrame:
        """The live rows of ``kind`` for some terms, keys or grams, from their buckets alone."""
        values = sorted(set(values))
        rows = self.read(kind, only=F.col("bucket").isin(sorted({bucket_of(v, self.buckets) for v in values})) & F.col(column).isin(values))
        return self.live(rows) if "doc" in rows.columns else rows

    # Sums for ranking, from the manifest.

    @property
    def count(self) -> int:
        return sum(s["docs"] - s["dead_docs"] for s in self.segments)

    def mean_length(self, field: str) -> float:
        return sum(s["lengths"][field] - s["dead_lengths"][field] for s in self.segments) / max(self.count, 1)


# Manifests.


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop, hadoop(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _publish(index: Index) -> Index:
    """Makes the version of ``index`` the newest one; fails if there is one of its number."""
    hadoop, fs = _fs(index.spark, index.path)
    text = json.dumps({"buckets": index.buckets, "segments": index.segments})
    draft, final = hadoop(f"{index.path}/manifests/.draft-{uuid.uuid4().hex}"), hadoop(f"{index.path}/manifests/{index.version:012d}.json")
    out = fs.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"version {index.version} of {index.path} was written by another update")
    return index


def open_index(spark: SparkSession, path: str, version: int | None = None) -> Index | None:
    """The newest version, or an older one that was not vacuumed; None if there is none."""
    hadoop, fs = _fs(spark, path)
    if not fs.exists(hadoop(f"{path}/manifests")):
        return None
    found = sorted(int(f.getPath().getName().removesuffix(".json")) for f in fs.listStatus(hadoop(f"{path}/manifests")) if not f.getPath().getName().startswith("."))
    if not found or (version is not None and version not in found):
        return None
    version = found[-1] if version is None else version
    m = json.loads(spark.read.text(f"{path}/manifests/{version:012d}.json", wholetext=True).first()[0])
    return Index(spark, path, version, m["buckets"], tuple(m["segments"]))


def vacuum(index: Index) -> None:
    """Deletes versions before this one, and tables that only they have."""
    hadoop, fs = _fs(index.spark, index.path)
    kept = {"manifests"} | {s["name"] for s in index.segments} | {d.split("/")[0] for s in index.segments for d in s["dead"]}
    for f in fs.listStatus(hadoop(index.path)):
        if f.getPath().getName() not in kept:
            fs.delete(f.getPath(), True)
    for f in fs.listStatus(hadoop(f"{index.path}/manifests")):
        if f.getPath().getName() < f"{index.version:012d}.json":
            fs.delete(f.getPath(), False)


# Segments.


def _dealt(rows: DataFrame, order: list[str], spread: int, tasks: int) -> DataFrame:
    """Rows dealt by bucket and sorted; a bucket goes to ``spread`` tasks."""
    dealt = F.pmod(F.xxhash64("doc" if "doc" in rows.columns else order[0]), F.lit(spread))
    return rows.withColumn("_spread", dealt).repartition(tasks, "bucket", "_spread").sortWithinPartitions("bucket", *order).drop("_spread")


def _write(rows: DataFrame, path: str, order: list[str], spread: int, tasks: int) -> None:
    """Rows in a folder for each bucket, sorted."""
    _dealt(rows, order, spread, tasks).write.partitionBy("bucket").parquet(path)


def numbered(rows: DataFrame, segment: int) -> DataFrame:
    """``rows`` (a written table) with ``doc``: the segment's number and the row's."""
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each task
    before = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    out = rows.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.withColumn("doc", F.lit(segment).cast("long") * (1 << PAGE_BITS) + F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_base")


def words_by_field() -> list[Column]:
    """The words of each field."""
    return [T.terms(F.coalesce(search.field_text(name), F.lit(""))).alias(name) for name in FIELDS]


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for what is written within."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs (term, field, first, n, wide, data) of pages (doc, arrays of words): one for each word of a field in a batch.

    ``data`` has of its ``n`` postings the docs after ``first``, the counts, the fields' lengths, and all places, as numbers of two
    or four bytes.
    """
    for batch in batches:
        docs, lists = batch.column(0).to_numpy(), [batch.column(i + 1) for i in range(batch.num_columns - 1)]
        pages, fields = len(docs), len(lists)
        each = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists])  # words of each field and page, fields first
        if not each.sum():
            continue
        words = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        owner = np.repeat(np.arange(len(each)), each)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
        key = words.indices.to_numpy().astype(np.int64) * fields + owner // pages
        order = np.argsort(key, kind="stable")  # by page and place within a word of a field
        key, owner, place = key[order], owner[order], place[order]
        posting = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
        pack = np.flatnonzero(np.r_[True, key[posting][1:] != key[posting][:-1]])  # the first posting of each
        tf, dl, doc, head = np.diff(np.r_[posting, len(key)]), each[owner[posting]], docs[owner[posting] % pages], key[posting[pack]]
        n = np.diff(np.r_[pack, len(posting)])
        after = doc - np.repeat(doc[pack], n)
        wide = max(int(x.max()) for x in (after, dl)) >= 1 << 16
        kind = np.int32 if wide else np.uint16
        after, tf, dl, place = (x.astype(kind) for x in (after, tf, dl, place))
        cut, ends, rows = np.r_[pack, len(posting)].tolist(), np.r_[posting[pack], len(key)].tolist(), []
        for i in range(len(pack)):
            a, b = cut[i], cut[i + 1]
            rows.append(b"".join((after[a:b].tobytes(), tf[a:b].tobytes(), dl[a:b].tobytes(), place[ends[i] : ends[i + 1]].tobytes())))
        yield pa.RecordBatch.from_arrays(
            [words.dictionary.take(pa.array(head // fields)), pa.array((head % fields).astype(np.int32)), pa.array(doc[pack]), pa.array(n.astype(np.int32)), pa.array(np.full(len(pack), wide)), pa.array(rows, pa.binary())],
            names=["term", "field", "first", "n", "wide", "data"],
        )


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of packs."""
    for batch in batches:
        n = batch.column("n").to_numpy().astype(np.int64)
        firsts, wide, data = batch.column("first").to_numpy(), batch.column("wide").to_pylist(), batch.column("data")
        parts = [np.frombuffer(data[i].as_buffer(), np.int32 if w else np.uint16) for i, w in enumerate(wide)]
        cut = lambda k: np.concatenate([x[k * m : (k + 1) * m] for x, m in zip(parts, n.tolist(), strict=True)])
        row = pa.array(np.repeat(np.arange(len(n)), n))
        tf = cut(1).astype(np.int32)
        places = np.concatenate([x[3 * m :] for x, m in zip(parts, n.tolist(), strict=True)]).astype(np.int32)
        ends = pa.array(np.r_[0, np.cumsum(tf, dtype=np.int64)].astype(np.int32))
        field = pa.array(FIELDS).take(batch.column("field").take(row))
        columns = [batch.column("term").take(row), field, pa.array(np.repeat(firsts, n) + cut(0)), pa.array(tf), pa.array(cut(2).astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(places)), batch.column("bucket").take(row)]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "field", "doc", "tf", "dl", "places", "bucket"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings, sorted by bucket, term, field and doc, as packs."""
    for batch in batches:
        c = {x: batch.column(x) for x in ("bucket", "term", "field", "doc", "tf", "dl", "places")}
        same = pa.compute.and_(*[pa.compute.equal(c[x].slice(1), c[x].slice(0, batch.num_rows - 1)) for x in ("term", "field")]).to_numpy(zero_copy_only=False)
        segment = c["doc"].to_numpy() >> PAGE_BITS  # numbers of one pack are close enough for four bytes
        start = np.flatnonzero(np.r_[True, ~same | (segment[1:] != segment[:-1])]).tolist()
        doc, tf, dl, place = c["doc"].to_numpy(), c["tf"].to_numpy(), c["dl"].to_numpy(), c["places"].flatten().to_numpy()
        upto, rows, wides = np.r_[0, np.cumsum(tf, dtype=np.int64)], [], []
        for a, b in zip(start, [*start[1:], batch.num_rows], strict=True):
            after = doc[a:b] - doc[a]
            wides.append(bool(max(after.max(), dl[a:b].max()) >= 1 << 16))
            kind = np.int32 if wides[-1] else np.uint16
            rows.append(b"".join(x.astype(kind).tobytes() for x in (after, tf[a:b], dl[a:b], place[upto[a] : upto[b]])))
        at = pa.array(start)
        field = pa.compute.index_in(c["field"].take(at), pa.array(FIELDS)).cast(pa.int32())
        columns = [c["term"].take(at), field, c["doc"].take(at), pa.array(np.diff([*start, batch.num_rows]).astype(np.int32)), pa.array(wides), pa.array(rows, pa.binary()), c["bucket"].take(at)]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "field", "first", "n", "wide", "data", "bucket"])


_UNDEALT = "term string, field int, first long, n int, wide boolean, data binary"
#: The table of postings as it is stored.
PACKS = f"{_UNDEALT}, bucket int"


def path_grams(path: Column) -> Column:
    """Distinct runs of up to GRAM characters of a path with a slash before it."""
    whole = F.lower(F.concat(F.lit("/"), path))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(whole)), lambda i: F.array(*[F.substring(whole, i, F.lit(n + 1)) for n in range(GRAM)]))))


def _sums(rows: DataFrame) -> dict[int, dict]:
    """Pages and the length of each field over ``rows`` of names, by the segment that numbered them."""
    total = [F.sum(F.col("lengths")[i]).alias(f) for i, f in enumerate(FIELDS)]
    found = rows.groupBy(F.shiftright("doc", PAGE_BITS).alias("number")).agg(F.count("*").alias("n"), *total).collect()  # a row for each number
    return {r["number"]: {"docs": r["n"], "lengths": {f: r[f] for f in FIELDS}} for r in found}


def _added(sums: Iterable[dict]) -> tuple[int, dict[str, int]]:
    sums = list(sums)
    return sum(s["docs"] for s in sums), {f: sum(s["lengths"][f] for s in sums) for f in FIELDS}


def _packs(pages: DataFrame, bucket, spread: int, tasks: int) -> DataFrame:
    """The packs of pages (doc, arrays of words), dealt as ``_write`` deals rows and in the order in which they are written."""
    packs = pages.mapInArrow(_inverted, _UNDEALT).select("*", bucket("term"), F.pmod(F.xxhash64("first"), F.lit(spread)).alias("_spread"))
    return packs.repartition(tasks, "bucket", "_spread").sortWithinPartitions("bucket", "term", "first")


def _segment(index: Index, corpus: DataFrame) -> dict:
    """Writes the tables of the pages of ``corpus`` (with row_hash); its entry for the manifest."""
    spark, name = index.spark, f"segment-{uuid.uuid4().hex}"
    path, number = f"{index.path}/{name}", max((n for s in index.segments for n in s["numbers"]), default=-1) + 1
    # the body is mostly the whole page, which is written once then
    stored = corpus.select(*COLUMNS, "row_hash", F.col("body").eqNullSafe(F.col("content")).alias("_whole")).withColumn("body", F.when(~F.col("_whole"), F.col("body")))
    stored.write.parquet(f"{path}/input")
    docs = numbered(spark.read.schema(stored.schema).parquet(f"{path}/input"), number).withColumn("body", F.when(F.col("_whole"), F.col("content")).otherwise(F.col("body"))).drop("_whole")
    lengths = F.array(*[F.size(T.terms(F.coalesce(search.field_text(f), F.lit("")))) for f in FIELDS])
    docs.select("doc", "path_rel", "title", "row_hash", lengths.alias("lengths"), F.shiftright("doc", PART_BITS).alias("part")).write.partitionBy("part").parquet(f"{path}/names")
    docs.select("doc", "path_rel", "summary", "aliases", "tags", "keywords", "content").write.parquet(f"{path}/pages")
    bucket = lambda c: (F.crc32(c) % index.buckets).cast("int").alias("bucket")

    count, total = _added(_sums(spark.read.schema(SCHEMAS["names"]).parquet(f"{path}/names")).values())
    spread, tasks = _tasks(index, count)
    # words are gathered within tasks, so that packs of places are shuffled instead of words, and sorted instead of postings
    with _settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(INVERTED_PAGES)):
        packs = _packs(docs.select("doc", *words_by_field()), bucket, spread, tasks)
        packs.drop("_spread").write.partitionBy("bucket").parquet(f"{path}/postings")

    keys = F.concat(F.array(F.struct(F.lit(0).alias("kind"), T.key_of("title").alias("key"))), F.transform(F.coalesce("aliases", F.array()), lambda a: F.struct(F.lit(1).alias("kind"), T.key_of(a).alias("key"))))
    _write(docs.select("doc", F.inline(keys)).where(F.col("key").isNotNull()).select("key", "doc", "kind", bucket("key")), f"{path}/keys", ["key"], spread, tasks)
    grams = docs.select("doc", F.explode(path_grams(F.col("path_rel"))).alias("gram"))
    _write(grams.select("gram", "doc", bucket("gram")), f"{path}/grams", ["gram"], spread, tasks)
    _write_gram_counts(spark, path, tasks)
    _delete(spark, f"{path}/input")
    return {"name": name, "numbers": [number], "docs": count, "lengths": total, "dead": [], "dead_docs": 0, "dead_lengths": dict.fromkeys(FIELDS, 0)}


def _delete(spark: SparkSession, path: str) -> None:
    hadoop, fs = _fs(spark, path)
    fs.delete(hadoop(path), True)


def _tasks(index: Index, pages: int) -> tuple[int, int]:
    """By how many tasks a bucket is written, and all of them."""
    spread = pages // SPREAD_PAGES + 1
    return spread, min(index.buckets * spread, max(int(index.spark.conf.get("spark.sql.shuffle.partitions")), 4 * spread))


def _write_gram_counts(spark: SparkSession, path: str, tasks: int) -> None:
    _write(spark.read.schema(SCHEMAS["grams"]).parquet(f"{path}/grams").groupBy("bucket", "gram").agg(F.count("*").alias("n")), f"{path}/gram_counts", ["gram"], 1, tasks)


def _bury(index: Index, gone: DataFrame) -> tuple[dict, ...]:
    """The segments after the pages ``gone`` (doc) died."""
    name = f"dead-{uuid.uuid4().hex}"
    gone.withColumn("number", F.shiftright("doc", PAGE_BITS)).write.partitionBy("number").parquet(f"{index.path}/{name}")
    gone = index.spark.read.schema("doc long, number long").parquet(f"{index.path}/{name}")
    lost = _sums(index.read("names").join(gone, "doc", "left_semi"))
    out = []
    for s in index.segments:
        mine = [n for n in s["numbers"] if n in lost]
        docs, lengths = _added(lost[n] for n in mine)
        out.append(s | {"dead": s["dead"] + [f"{name}/number={n}" for n in mine], "dead_docs": s["dead_docs"] + docs, "dead_lengths": {f: s["dead_lengths"][f] + lengths[f] for f in FIELDS}})
    return tuple(s for s in out if s["docs"] > s["dead_docs"])  # a segment without live pages goes


def _tier(segment: dict) -> int:
    n, tier = segment["docs"] - segment["dead_docs"], 0
    while n >= TIER:
        n, tier = n // TIER, tier + 1
    return tier


def compact(index: Index, all_: bool = False) -> Index:
    """Merges segments of one tier where there are MERGE or more, and segments of which most pages are dead; or all of them."""
    tiers: dict[int, list[dict]] = {}
    for s in index.segments:
        tiers.setdefault(0 if all_ else _tier(s), []).append(s)
    groups = [g for g in tiers.values() if len(g) >= (2 if all_ else MERGE)] + [[s] for g in tiers.values() if len(g) < MERGE and not all_ for s in g if 2 * s["dead_docs"] > s["docs"]]
    if not groups:
        return index
    segments = [s for s in index.segments if not any(s in g for g in groups)]
    for group in groups:
        name = f"segment-{uuid.uuid4().hex}"
        path, docs = f"{index.path}/{name}", sum(s["docs"] - s["dead_docs"] for s in group)
        spread, tasks = _tasks(index, docs)
        postings = _dealt(index.live(index.read("postings", group), group).select(*(c.split()[0] for c in SCHEMAS["postings"].split(", "))), ["term", "field", "doc"], spread, tasks)
        postings.mapInArrow(_packed, PACKS).write.partitionBy("bucket").parquet(f"{path}/postings")
        for kind, order in (("keys", ["key"]), ("grams", ["gram"])):
            _write(index.live(index.read(kind, group), group), f"{path}/{kind}", order, spread, tasks)
        _write_gram_counts(index.spark, path, tasks)
        index.live(index.read("names", group), group).write.partitionBy("part").parquet(f"{path}/names")
        index.live(index.read("pages", group), group).write.parquet(f"{path}/pages")
        lengths = {f: sum(s["lengths"][f] - s["dead_lengths"][f] for s in group) for f in FIELDS}
        segments.append({"name": name, "numbers": sorted(n for s in group for n in s["numbers"]), "docs": docs, "lengths": lengths, "dead": [], "dead_docs": 0, "dead_lengths": dict.fromkeys(FIELDS, 0)})
    return _publish(Index(index.spark, index.path, index.version + 1, index.buckets, tuple(segments)))


def update(spark: SparkSession, path: str, corpus: DataFrame, deleted: DataFrame | None = None, whole: bool = False) -> Index:
    """Brings the index at ``path`` to ``corpus``, whose paths are unique; the newest version.

    ``corpus`` has new and changed pages, and any others.  Pages of the paths ``deleted`` (path_rel) go, with
    ``whole`` all pages that ``corpus`` does not have, for whatever reason.  Only pages whose columns changed are
    written; if there are none and nothing goes, there is no new version.
    """
    index = open_index(spark, path)
    corpus = corpus.select(*COLUMNS).withColumn("row_hash", row_hash())
    if index is None:
        size = corpus.agg(F.sum(F.octet_length("content"))).first()[0] or 0  # one number
        index = Index(spark, path, -1, max(LEAST_BUCKETS, min(MOST_BUCKETS, size // BUCKET_BYTES)), ())
    hashes = written(corpus.select("path_rel", "row_hash"), "index-hashes")
    live = index.names().select("path_rel", F.col("row_hash").alias("old_hash"), "doc")
    changed = written(hashes.join(live, "path_rel", "left").where(F.col("doc").isNull() | (F.col("old_hash") != F.col("row_hash"))).select("path_rel", "doc"), "index-changed")
    gone = changed.where(F.col("doc").isNotNull()).select("doc")
    if whole:
        gone = gone.unionByName(live.join(hashes, "path_rel", "left_anti").select("doc"))
    elif deleted is not None:
        gone = gone.unionByName(live.join(deleted.select("path_rel"), "path_rel", "left_semi").select("doc")).distinct()
    gone = written(gone, "index-gone")
    new, dead = not changed.isEmpty(), not gone.isEmpty()
    if new or dead or index.version < 0:
        segments = _bury(index, gone) if dead else index.segments
        if new:
            incoming = corpus.join(changed.select("path_rel"), "path_rel", "left_semi") if index.segments else corpus
            if deleted is not None and not whole:
                incoming = incoming.join(deleted.select("path_rel"), "path_rel", "left_anti")
            segments = (*segments, _segment(index, incoming))
        index = compact(_publish(Index(spark, path, index.version + 1, index.buckets, segments)))
    for table in (hashes, changed, gone):
        _delete(spark, table.written_path)
    return index


# Ranked search over an index, with the rows of the operators over a corpus.


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def hits(index: Index, query: Query) -> DataFrame:
    """(doc, field, unit, tf, dl) of the query's words and phrases; of a phrase also repeats that overlap count."""
    units = search._units(query)
    listed = index.listed("postings", "term", [w for u in units for w in u])
    found = []
    for i, unit in enumerate(units):
        rows = listed.where(F.col("term").isin(list(set(unit))))
        if len(unit) == 1:
            found.append(rows.select("doc", "field", F.lit(i).alias("unit"), "tf", "dl"))
            continue
        place = {w: f"p{k}" for k, w in enumerate(dict.fromkeys(unit))}
        rows = rows.groupBy("doc", "field").agg(F.max("dl").alias("dl"), *[F.max(F.when(F.col("term") == w, F.col("places"))).alias(p) for w, p in place.items()])
        starts = reduce(F.array_intersect, [_shifted(F.col(place[w]), k) for k, w in enumerate(unit)])
        found.append(rows.select("doc", "field", F.lit(i).alias("unit"), F.size(starts).alias("tf"), "dl").where(F.col("tf") > 0))
    return reduce(DataFrame.unionByName, found)


def scores(index: Index, query: Query) -> DataFrame:
    """(doc, score) of the pages that hold at least one of the query's words or phrases."""
    if not search._units(query):
        return index.spark.createDataFrame([], "doc long, score double")
    rows = hits(index, query)
    df = rows.groupBy("field", "unit").agg(F.count("*").alias("df"))  # a row for each field and unit
    of = lambda values: F.coalesce(*[F.when(F.col("field") == k, F.lit(float(v))) for k, v in values.items()])
    idf = F.log(1 + (F.lit(index.count) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (search.K1 + 1) / (F.col("tf") + search.K1 * (1 - search.B + search.B * F.col("dl") / of({f: index.mean_length(f) for f in FIELDS})))
    return rows.join(F.broadcast(df), ["field", "unit"]).groupBy("doc").agg(F.sum(of(search.WEIGHTS) * part).alias("score"))


def bm25(index: Index, query: Query) -> DataFrame:
    """(path_rel, title, score)."""
    return scores(index, query).join(index.read("names").select("doc", "path_rel", "title"), "doc").select("path_rel", "title", "score")


def exact_tier(index: Index, query: Query) -> DataFrame:
    """(doc, rank)."""
    return index.listed("keys", "key", [query.text]).groupBy("doc").agg(F.min("kind").cast("double").alias("rank"))


def path_tier(index: Index, query: Query, root: str = "") -> DataFrame:
    """(path_rel, title, doc, rank) of the pages with all tokens in their path, relative or absolute.

    Tokens of the root hold for every page.  The pages of each token's rarest gram are intersected, rarest first,
    and their paths are looked at then.  A token of one or two characters is a gram itself; one with
    characters that are neither letters nor numbers is looked for in all paths.
    """
    names = index.read("names").select("part", "doc", "path_rel", "title")
    tokens = [t for t in query.tokens if t not in f"{root.lower()}/"]
    none = F.lit(0.0).alias("rank")
    if not query.tokens:
        return names.where(F.lit(False)).select("path_rel", "title", "doc", none)
    hit = reduce(Column.__and__, [F.contains(F.lower(F.concat_ws(" ", "path_rel", F.concat(F.lit(root + "/"), F.col("path_rel")))), F.lit(t)) for t in query.tokens])
    indexed = [t for t in tokens if words_of(t) == [t]]
    if not indexed:
        return index.live(names.where(hit)).select("path_rel", "title", "doc", none)
    grams = {t: [t[i : i + GRAM] for i in range(max(1, len(t) - GRAM + 1))] for t in indexed}
    counts = {r["gram"]: r["n"] for r in index.listed("gram_counts", "gram", {g for gs in grams.values() for g in gs}).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row for each gram of the query
    rarest = sorted({min(gs, key=lambda g: counts.get(g, 0)) for gs in grams.values()}, key=lambda g: counts.get(g, 0))
    found = index.listed("grams", "gram", rarest[:1]).select("doc")
    for gram in rarest[1:]:
        found = found.join(index.read("grams", only=(F.col("bucket") == bucket_of(gram, index.buckets)) & (F.col("gram") == gram)).select("doc"), "doc", "left_semi")
    found = found.withColumn("part", F.shiftright("doc", PART_BITS))
    return names.join(found, ["part", "doc"]).where(hit).select("path_rel", "title", "doc", none)


def tiers(index: Index, text: str, root: str = "") -> DataFrame:
    """(title, path_rel, tier, rank, doc): all matches, once for each title, as ``search.tiers``."""
    query = parse_query(text)
    names = index.read("names").select("doc", "path_rel", "title")
    columns = ["path_rel", "title", "doc", "rank"]
    found = exact_tier(index, query).join(names, "doc").select(*columns, F.lit(0).alias("tier")).unionByName(path_tier(index, query, root).select(*columns, F.lit(1).alias("tier")))
    if query.searchable:
        ranked = scores(index, query).join(names, "doc").select("path_rel", "title", "doc", (-F.round("score", 6)).alias("rank"), F.lit(2).alias("tier"))
        found = found.unionByName(ranked)
    order = F.struct("tier", "rank", search.place_in_tier(), "path_rel", "doc")
    return found.groupBy("title").agg(F.min(order).alias("o")).select("title", "o.path_rel", "o.tier", "o.rank", "o.doc")


def _pages(index: Index, docs: DataFrame) -> DataFrame:
    """The stored columns of a result's few pages; their numbers are pushed to the scan."""
    ids = [r["doc"] for r in docs.select("doc").collect()]  # at most a result's limit
    return index.read("pages").where(F.col("doc").isin(ids))


def search_page(index: Index, text: str, limit: int = search.DEFAULT_LIMIT, offset: int = 0, root: str = "") -> DataFrame:
    """One page of results, as ``search.search``; what was ranked is written once and read for the page and the total."""
    query = parse_query(text)
    ranked = written(tiers(index, text, root), "ranked")
    order = [F.col("tier"), F.col("rank"), search.place_in_tier(), F.col("path_rel")]
    page = ranked.orderBy(*order).limit(max(limit, 0) + offset if limit > 0 else 0)
    page = page.withColumn("position", F.row_number().over(Window.orderBy(*order))).where(F.col("position") > offset)
    total = ranked.agg(F.count("*").alias("total"))  # a single row
    page = written(page.join(F.broadcast(total)), "page")
    out = _pages(index, page).drop("path_rel").join(F.broadcast(page), "doc")  # at most ``limit`` rows
    return out.select("position", "title", F.col("path_rel").alias("file"), "summary", search.snippets("content", query.tokens).alias("snippets"), "total")


def suggest(index: Index, text: str, limit: int = search.SUGGEST_LIMIT, least: float = search.SUGGEST_SCORE) -> DataFrame:
    """The best full-text matches, as ``search.suggest``."""
    query = parse_query(text)
    top = scores(index, query).withColumn("rounded", F.round("score", 6)).join(index.read("names").select("doc", "path_rel", "title"), "doc")
    top = written(top.orderBy(F.desc("rounded"), "title", "path_rel").limit(limit), "suggested")
    out = _pages(index, top).drop("path_rel").join(F.broadcast(top), "doc")
    return out.where(T.match_fraction(list(query.tokens), "title", "summary", "content") >= least).select("title", F.col("path_rel").alias("file"), "summary", F.col("rounded").alias("score"))


def contents(index: Index) -> DataFrame:
    """(path_rel, field, terms, words, placed): sums over the words of each field of each live page, to compare the index with another."""
    placed = F.sum(F.length("term") * F.aggregate("places", F.lit(0).cast("long"), lambda a, x: a + x))
    rows = index.live(index.read("postings")).groupBy("doc", "field").agg(F.count("*").alias("terms"), F.sum("tf").alias("words"), placed.alias("placed"))
    return rows.join(index.names().select("doc", "path_rel"), "doc").select("path_rel", "field", "terms", "words", "placed")
