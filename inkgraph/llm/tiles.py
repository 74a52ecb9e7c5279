"""Candidate groups whose members are not yet in one component, compared in tiles of bounded size.

A group (``run``) is the members that share one key.  Groups of one ``lead`` have
mostly the same members, so their pairs are found together: the members of a
lead are cut into parts, a tile is a pair of parts, and every tile is worked on by
itself, whatever the number of its groups.  Within a tile a pair is marked once.
The groups of a lead with very many entries are dealt to slices, which have tiles of their own.
A lead of one part is read as it is.  Entries of other leads are gathered into packs, one for
a part, and packs are what tiles are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Members on each side of a tile, about, and entries of a tile, and of the tiles that a task gets at once.
TILE, TILE_ROWS = 1024, 100_000
#: A further round of stars follows if the last one closed this share of the open rows.
PROGRESS = 0.3


def open_entries(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries of groups whose members are not all in one component, with their components."""
    rows = entries.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = rows.groupBy("run").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("run")
    return rows.join(apart, "run", "left_semi").select(*entries.columns, "component")


def stars(rows: DataFrame, names: list[str], turn: int, center: Column | None = None) -> DataFrame:
    """Each entry beside one member of its group of another component, another one in each turn; a row for each entry at most.

    ``names`` are the columns of the member, which gets them with ``p_`` before; ``center`` says which may be it.
    """
    order = F.xxhash64("run", "node", F.lit(turn))
    pivot = rows.groupBy("run").agg(F.max_by(F.struct(*[F.col(c).alias(f"p_{c}") for c in (*names, "component")]), order if center is None else F.when(center, order)).alias("pivot"))
    return rows.join(pivot, "run").select(*names, "component", "pivot.*").where("component <> p_component")


def deal(rows: DataFrame) -> DataFrame:
    """What ``each_tile`` reads, by group: entries of leads of one part, and a pack of entries for each side of all other tiles.

    Pairs of members that meet in groups of several slices are found in each.
    """
    size = rows.groupBy("lead").agg(F.approx_count_distinct("node").alias("m"), F.count("*").alias("e"))
    parts = F.greatest(F.ceil(F.col("m") / TILE), F.lit(1))
    slices = F.ceil(F.col("e") * F.least("parts", F.lit(2)) / (F.col("parts") * TILE_ROWS))
    size = written(size.withColumn("parts", parts.cast("int")).withColumn("slices", slices.cast("int")), "tiles")
    total, tiles = size.agg(F.sum(F.col("e") * F.col("parts")), F.sum(F.when((F.col("parts") > 1) | (F.col("slices") > 1), F.expr("parts * (parts + 1) / 2 * slices")))).first()
    groups = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), (total or 0) // TILE_ROWS, int(tiles or 0))
    sized = rows.join(size.select("lead", "parts", "slices"), "lead").withColumn("slice", F.pmod(F.xxhash64("run"), F.col("slices")).cast("int"))
    group = lambda *tile: F.pmod(F.xxhash64("lead", *tile, "slice"), F.lit(groups)).alias("group")
    whole = sized.where("parts = 1").select(group(F.lit(0), F.lit(0)), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("part"), *rows.columns, F.lit(None).cast("binary").alias("pack"))

    rows_of = rows.columns

    def pack(table: pa.Table) -> pa.Table:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.select(rows_of).schema) as stream:
            stream.write_table(table.select(rows_of))
        first = table.slice(0, 1).select(["lead", "part", "parts", "slice"])
        return first.append_column("pack", pa.array([out.getvalue().to_pybytes()], pa.binary()))

    packs = sized.where("parts > 1").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    packs = packs.groupBy("lead", "part", "slice").applyInArrow(pack, "lead long, part int, parts int, slice int, pack binary")
    packs = packs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"x": F.least("part", "other"), "y": F.greatest("part", "other")})
    return whole.unionByName(packs.select(group("x", "y"), "x", "y", "part", "pack"), allowMissingColumns=True)


def each_tile(table: pa.Table, names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each tile in a group of ``deal``, its entries by run."""
    names = list(dict.fromkeys(["lead", "run", "node", "component", *names]))
    packed = table.column("pack").is_valid()
    whole = table.filter(table.column("pack").is_null())
    every = [{name: whole.column(name).to_numpy() for name in ("x", "y", "part", *names)}]
    for row in table.filter(packed).select(["x", "y", "part", "pack"]).to_pylist():
        entries = pa.ipc.open_stream(row["pack"]).read_all()
        every.append({name: np.full(entries.num_rows, row[name], np.int32) for name in ("x", "y", "part")} | {name: entries.column(name).to_numpy() for name in names})
    c = {name: np.concatenate([e[name] for e in every if len(e[name])] or [every[0][name]]) for name in every[0]}
    order = np.lexsort([c[name] for name in ("run", "y", "x", "lead")])
    c = {name: x[order] for name, x in c.items()}
    new = np.r_[True, (c["lead"][1:] != c["lead"][:-1]) | (c["x"][1:] != c["x"][:-1]) | (c["y"][1:] != c["y"][:-1])] if len(order) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    for a, b in zip(start, np.r_[start[1:], len(new)], strict=False):
        yield {name: x[a:b] for name, x in c.items()}


def pairs_of_tile(c: dict[str, np.ndarray], candidate) -> tuple[np.ndarray, np.ndarray]:
    """Two entries each of the tile's pairs of members in different components, each pair once whatever the number of groups it shares.

    ``candidate`` says for entries i (a column) and j (a row) of one group which are candidates.
    """
    _, first, at = np.unique(c["node"], return_index=True, return_inverse=True)
    part, component = c["part"][first], c["component"][first]
    x, y = c["x"][0], c["y"][0]
    left, right = np.flatnonzero(part == x), np.flatnonzero(part == y)
    number = np.empty(len(first), np.int64)
    number[left] = np.arange(len(left))
    if x != y:
        number[right] = np.arange(len(right))
    found = np.zeros((len(left), len(right)), bool)
    start = np.flatnonzero(np.r_[True, c["run"][1:] != c["run"][:-1]])
    for a, b in zip(start, np.r_[start[1:], len(at)], strict=True):
        own = np.arange(a, b)
        i, j = own[part[at[a:b]] == x], own[part[at[a:b]] == y]
        if len(i) and len(j):
            found[np.ix_(number[at[i]], number[at[j]])] |= candidate(i[:, None], j[None, :])
    if x == y:
        found = found | found.T  # either entry may come first in a group
        found = np.triu(found, 1)
    i, j = np.nonzero(found)
    i, j = left[i], right[j]
    apart = component[i] != component[j]
    return first[i[apart]], first[j[apart]]
