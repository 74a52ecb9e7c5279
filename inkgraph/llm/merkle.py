"""A Merkle manifest of a dataset: leaf digests, a tree for each language, a root, and a proof for every row.

Leaves are sorted by range, so each part of the data holds runs of
neighbouring leaves.  A part folds its runs to a sparse forest: the nodes,
keyed by level and index, whose run of siblings it does not have whole.  As the
number of a tree's leaves is known, so is the arity of every run, also of the
last one of a level.  Forests are merged by a tree reduction: some dozens of
parts at a time, then dozens of these, until a tree is one node; whenever a
run is complete it becomes its parent.  Merging is associative, since a node
depends on its leaves alone.  A forest holds two nodes a level at most on
each side of its run, however many leaves it stands for.

For proofs each part asks for the few siblings at the edges of its runs, which
the reduction has met, and makes all others itself again.

Nulls are written ``-``.  Rows of one id in a language are ordered by their
leaf digest; equal rows are leaves of their own.  An id that is null comes
first and is not tampered with.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import scratch, written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves of a part, about, and forests that are merged at a time.
PART_LEAVES, FAN = 1 << 17, 64
#: Rows that are hashed to a modulus of zero are tampered with.
TAMPERED = 7

NODE = "tree string, level int, idx long, n long, digest string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(columns: dict[str, Column]) -> Column:
    """Of the values of a row: each as its count of bytes, a colon and the value."""
    value = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[value(c.cast("string")) for c in columns.values()]), 256)


def heights(n: int) -> list[int]:
    """Nodes on each level of a tree of ``n`` leaves, up to the root."""
    counts = [n]
    while counts[-1] > 1:
        counts.append((counts[-1] + 1) // 2)
    return counts


def resolve(nodes: dict[tuple[int, int], str], n: int) -> list[tuple[int, int, str]]:
    """Replaces complete runs of siblings by their parents, as long as there are any; all new parents."""
    counts, made, queue = heights(n), [], sorted(nodes)
    while queue:
        parents = set()
        for level, idx in queue:
            first = idx & ~1
            run = [(level, i) for i in range(first, min(first + 2, counts[level]))]
            if level + 1 < len(counts) and all(x in nodes for x in run):
                parents.add((level + 1, idx >> 1))
                nodes[level + 1, idx >> 1] = digest("".join(nodes.pop(x) for x in run))
                made.append((level + 1, idx >> 1, nodes[level + 1, idx >> 1]))
        queue = sorted(parents)
    return made


def levels_of(base: int, leaves: list[str], n: int) -> list[tuple[int, list[str]]]:
    """(index of the first, digests) on each level of the nodes that neighbouring leaves make on their own."""
    counts, out = heights(n), [(base, leaves)]
    for level in range(len(counts) - 1):
        start, below = out[-1]
        first = start + (start & 1)  # a run that starts before these leaves is not whole
        end = start + len(below)
        if end < counts[level]:
            end -= end & 1
        above = [digest("".join(below[i - start : i - start + 2])) for i in range(first, end, 2)] if first < end else []
        out.append((first // 2, above))
    return out


def open_nodes(levels: list[tuple[int, list[str]]], n: int) -> Iterator[tuple[int, int, str]]:
    """(level, idx, digest) of those nodes whose parent is not among them."""
    for level, (start, own) in enumerate(levels):
        above_start, above = levels[level + 1] if level + 1 < len(levels) else (0, [])
        for i in {*range(min(2, len(own))), *range(max(0, len(own) - 2), len(own))}:
            if not above_start <= (start + i) >> 1 < above_start + len(above):
                yield level, start + i, own[i]


# Sorted leaves in parts.


def sorted_leaves(leaves: DataFrame, order: list[Column]) -> DataFrame:
    """The written table of ``leaves`` (tree, digest, others) with part and row, by tree and order; equal rows may be split."""
    count = leaves.count()
    parts = max(int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // PART_LEAVES)) if count > 10_000 else 1
    by = [F.asc_nulls_first("tree"), *order, F.col("tie")]
    rows = leaves.withColumn("tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by) if parts > 1 else rows.coalesce(1).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()
    rows = rows.drop("tie").withColumn("at", at)
    return written(rows.withColumn("part", F.shiftright("at", 33).cast("int")).withColumn("row", F.col("at").bitwiseAND((1 << 33) - 1)).drop("at"), "leaves")


def pieces(leaves: DataFrame) -> DataFrame:
    """(part, tree, base, size, n): the run of each tree in each part, from which leaf it goes, and the leaves of the tree."""
    sizes = leaves.groupBy("part", "tree").agg(F.count("*").alias("size"))
    by = Window.partitionBy("tree")
    base = F.sum("size").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select("part", "tree", F.coalesce(base, F.lit(0)).alias("base"), "size", F.sum("size").over(by).alias("n"))


def _runs(leaves: pa.Table) -> Iterator[tuple[str | None, pa.Table]]:
    """Each tree of a part, with its leaves in order."""
    leaves = leaves.sort_by("row")
    trees = leaves.column("tree").to_pylist()
    start = 0
    for i in range(1, len(trees) + 1):
        if i == len(trees) or trees[i] != trees[start]:
            yield trees[start], leaves.slice(start, i - start)
            start = i


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_FOREST = pa.schema([("part", pa.int32()), ("tree", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("open", pa.bool_())])
FOREST = f"part int, {NODE}, open boolean"


def fold_part(leaves: pa.Table, info: pa.Table) -> pa.Table:
    """The forest of a part."""
    known = {r["tree"]: r for r in info.to_pylist()}
    rows = []
    for tree, run in _runs(leaves):
        piece = known[tree]
        part = run.column("part")[0].as_py()
        levels = levels_of(piece["base"], run.column("digest").to_pylist(), piece["n"])
        rows += [(part, tree, level, idx, piece["n"], x, True) for level, idx, x in open_nodes(levels, piece["n"])]
    return _table(rows, _FOREST)


def merge_forests(forests: pa.Table) -> pa.Table:
    """The forest of some parts: its open nodes, and those that were made and used up here."""
    trees: dict[str | None, tuple[int, dict]] = {}
    part = 0
    for r in forests.to_pylist():
        part = r["part"]
        trees.setdefault(r["tree"], (r["n"], {}))[1][r["level"], r["idx"]] = r["digest"]
    rows = []
    for tree, (n, nodes) in trees.items():
        made = resolve(nodes, n)
        rows += [(part, tree, level, idx, n, x, False) for level, idx, x in made if (level, idx) not in nodes]
        rows += [(part, tree, level, idx, n, x, True) for (level, idx), x in nodes.items()]
    return _table(rows, _FOREST)


def reduce_forests(leaves: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roots, nodes): the root of each tree, and all nodes that parts did not make on their own."""
    found = written(leaves.select("part", "tree", "row", "digest").groupBy("part").cogroup(runs.groupBy("part")).applyInArrow(fold_part, FOREST), "forest")
    nodes, most = found, found.agg(F.max("part")).first()[0] or 0  # one number
    while True:
        most //= FAN
        merged = found.where("open").withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("part").applyInArrow(merge_forests, FOREST)
        found = written(merged, "forest")
        nodes = nodes.unionByName(found)
        if not most:
            break
    roots = found.where("open").select("tree", "n", F.col("digest").alias("root"))
    return roots, nodes.select("tree", "level", "idx", "digest").distinct()


def asked_nodes(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(part, tree, level, idx, digest) of the nodes at the edges of each part's runs."""
    last = F.col("base") + F.col("size") - 1
    height = F.ceil(F.log2(F.greatest(F.col("n"), F.lit(1)).cast("double")) + 1).cast("int")
    edges = runs.select("part", "tree", "base", last.alias("last"), F.explode(F.sequence(F.lit(0), height)).alias("level"))
    lo, hi = F.expr("shiftright(base, level)"), F.expr("shiftright(last, level)")
    edges = edges.select("part", "tree", "level", F.explode(F.array_distinct(F.array(lo - 1, lo, hi, hi + 1))).alias("idx")).where("idx >= 0")
    a, b = edges.alias("a"), nodes.alias("b")
    same = F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.level") == F.col("b.level")) & (F.col("a.idx") == F.col("b.idx"))
    return a.join(b, same).select("a.part", "a.tree", "a.level", "a.idx", "b.digest")


class Paths:
    """The siblings of the leaves of a run, from what the run makes itself and what was asked for."""

    def __init__(self, base: int, leaves: list[str], n: int, asked: dict[tuple[int, int], str]):
        self.counts, self.levels, self.asked = heights(n), levels_of(base, leaves, n), asked

    def node(self, level: int, idx: int) -> str:
        start, own = self.levels[level]
        return own[idx - start] if start <= idx < start + len(own) else self.asked[level, idx]

    def of(self, idx: int) -> tuple[str, str]:
        """(siblings one after the other, a letter for each level: on the left, on the right, none)."""
        siblings, sides = [], []
        for level, count in enumerate(self.counts[:-1]):
            other = idx ^ 1
            if other < count:
                siblings.append(self.node(level, other))
            sides.append("-" if other >= count else "l" if other < idx else "r")
            idx >>= 1
        return "".join(siblings), "".join(sides)


def fold_path(leaf: str, siblings: str, sides: str) -> str:
    """The root to which a leaf and its siblings fold."""
    at = 0
    for side in sides:
        other = siblings[at : at + 64] if side != "-" else ""
        at += len(other)
        leaf = digest(other + leaf if side == "l" else leaf + other)
    return leaf


_INFO = "part int, tree string, level int, idx long, digest string, base long, n long, root string, siblings string, sides string"


def _with_paths(leaves: pa.Table, info: pa.Table) -> Iterator[tuple[dict, pa.Table, Paths]]:
    asked: dict[str | None, dict] = {}
    known: dict[str | None, dict] = {}
    for r in info.to_pylist():
        if r["level"] is None:
            known[r["tree"]] = r
        else:
            asked.setdefault(r["tree"], {})[r["level"], r["idx"]] = r["digest"]
    for tree, run in _runs(leaves):
        piece = known[tree]
        yield piece, run, Paths(piece["base"], run.column("digest").to_pylist(), piece["n"], asked.get(tree, {}))


def prove_trees(leaves: pa.Table, info: pa.Table) -> pa.Table:
    """(tree, root, siblings, sides) of the trees that are the leaves of the last tree."""
    rows = []
    for piece, run, paths in _with_paths(leaves, info):
        rows += [(name, *paths.of(piece["base"] + i)) for i, name in enumerate(run.column("name").to_pylist())]
    return _table(rows, pa.schema([("tree", pa.string()), ("siblings", pa.string()), ("sides", pa.string())]))


_PROOF = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])
PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def prove_leaves(leaves: pa.Table, info: pa.Table) -> pa.Table:
    """The proof of each leaf of a part, folded from the leaf that is found now."""
    rows = []
    for piece, run, paths in _with_paths(leaves, info):
        ids, own, now = (run.column(c).to_pylist() for c in ("doc_id", "digest", "now"))
        for i, (doc_id, leaf, found) in enumerate(zip(ids, own, now, strict=True)):
            siblings, sides = paths.of(piece["base"] + i)
            siblings, sides = siblings + (piece["siblings"] or ""), sides + (piece["sides"] or "")
            folded = fold_path(found or leaf, siblings, sides)
            rows.append((doc_id, leaf, piece["digest"], piece["root"], digest(siblings), folded, folded == piece["root"]))
    return _table(rows, _PROOF)


def _info(runs: DataFrame, asked: DataFrame, *more: str) -> DataFrame:
    """Runs and answers in one table, by part."""
    empty = lambda kind: F.lit(None).cast(kind)
    fields = [f.split() for f in _INFO.split(", ")]
    a = runs.select(*[F.col(n) if n in ("part", "tree", "base", "n", *more) else empty(kind).alias(n) for n, kind in fields])
    b = asked.select(*[F.col(n) if n in ("part", "tree", "level", "idx", "digest") else empty(kind).alias(n) for n, kind in fields])
    return a.unionByName(b)


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row; in some rows n_chars is one more when proofs are checked."""
    with scratch() as keep:
        columns = {c: F.col(c) for c in COLUMNS}
        touched = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
        now = F.when(touched, leaf_digest(columns | {"n_chars": F.col("n_chars") + 1}))
        hashed = written(docs.select(F.col("lang").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(columns).alias("digest"), now.alias("now")), "digests")
        leaves = sorted_leaves(hashed, [F.asc_nulls_first("doc_id"), F.col("digest")])
        runs = written(pieces(leaves), "runs")
        roots, nodes = reduce_forests(leaves, runs)
        roots = written(roots, "roots")

        tops = sorted_leaves(roots.select(F.lit("").alias("tree"), F.col("root").alias("digest"), F.col("tree").alias("name")), [F.asc_nulls_first("name")])
        top_runs = written(pieces(tops), "runs")
        top_roots, top_nodes = reduce_forests(tops, top_runs)
        top = tops.groupBy("part").cogroup(_info(top_runs, asked_nodes(top_runs, top_nodes)).groupBy("part")).applyInArrow(prove_trees, "tree string, siblings string, sides string")
        root = top_roots.select(F.col("root"))  # a single row

        trees = roots.select(F.col("tree").alias("name"), F.col("root").alias("digest")).join(top.withColumnRenamed("tree", "top_name"), F.col("name").eqNullSafe(F.col("top_name"))).join(F.broadcast(root))
        placed = runs.join(trees, F.col("tree").eqNullSafe(F.col("name")))
        info = _info(placed, asked_nodes(runs, nodes), "digest", "root", "siblings", "sides")
        proofs = leaves.groupBy("part").cogroup(info.groupBy("part")).applyInArrow(prove_leaves, PROOF)
        return keep(written(proofs, "proofs"))
