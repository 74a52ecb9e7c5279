"""Connected components of links, by stars, as a distributed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: each node's neighbours are linked to the smallest node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    near = both.join(least, "u")
    moved = near.where("v > u").select(F.col("v").alias("x"), "m") if large else near.select(F.col("v").alias("x"), "m").union(least.select(F.col("u").alias("x"), "m"))
    return moved.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b long): the least node it is connected to.

    Alternates large and small star steps until nothing changes; each round is written to the
    shared folder.  A node's own neighbours never meet in one list.
    """
    rows = links.count()  # of a written table; no step makes more edges than there are links
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", rows)
    before = None
    while True:
        last, edges = edges, written(_stars(_stars(edges, True), False), "stars", rows)
        drop(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
