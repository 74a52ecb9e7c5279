"""Incremental sync: what changed between two inventories, and the corpus after it.

An inventory has path, mtime_ns, size_bytes, content_hash.  The new state is
computed from (path, hash) pairs alone, so there is no order of candidates and
no dependence on revision control for what counts as changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Version of the rules by which a corpus is made; another one means a full scan.
STRATEGY = 1


def change_set(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status): added, deleted, changed (other hash), touched (other time or size but the same hash) or unchanged."""
    a, b = old.select("path", F.struct("mtime_ns", "size_bytes", "content_hash").alias("a")), new.select("path", F.struct("mtime_ns", "size_bytes", "content_hash").alias("b"))
    status = (
        F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted")
        .when((F.col("a.mtime_ns") == F.col("b.mtime_ns")) & (F.col("a.size_bytes") == F.col("b.size_bytes")), "unchanged")
        .when(F.col("a.content_hash") == F.col("b.content_hash"), "touched").otherwise("changed")
    )
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def hash_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) by content hash alone, for sources without times; unchanged pages are left out."""
    both = old.select("path", F.col("content_hash").alias("a")).join(new.select("path", F.col("content_hash").alias("b")), "path", "full_outer")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", status.alias("status")).where("status is not null")


def renamed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old, new): paths that went and came with the same content, where that is unambiguous on the old side: one old path has the content."""
    single = old.groupBy("content_hash").agg(F.count("*").alias("n")).where("n = 1").select("content_hash")
    gone = old.join(single, "content_hash", "left_semi").join(new.select("path"), "path", "left_anti").select(F.col("path").alias("old"), "content_hash")
    came = new.join(old.select("path"), "path", "left_anti").select(F.col("path").alias("new"), "content_hash")
    return gone.join(came, "content_hash").select("old", "new")


def needs_full_scan(state: DataFrame, revision: str, source: str) -> bool:
    """Whether the stored state (revision, strategy, source) is of another making."""
    row = state.orderBy(F.col("synced_at").desc()).first() if "synced_at" in state.columns else state.first()
    return row is None or row["strategy"] != STRATEGY or row["source"] != source or row["revision"] != revision


def latest(pages: DataFrame) -> DataFrame:
    """The newest version of each path; of equal times the greater hash, so a repeat changes nothing."""
    order = Window.partitionBy("path").orderBy(F.col("mtime_ns").desc(), F.col("content_hash").desc())
    return pages.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def apply_changes(current: DataFrame, incoming: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """The corpus after an update: incoming versions replace, deleted paths go, unknown deletions are ignored."""
    kept = current if deleted is None else current.join(deleted.select("path"), "path", "left_anti")
    kept = kept.join(incoming.select("path"), "path", "left_anti")
    return kept.unionByName(incoming)


def inventory(pages: DataFrame) -> DataFrame:
    """(path, mtime_ns, size_bytes, content_hash) of pages with content and mtime_ns."""
    return pages.select("path", "mtime_ns", F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("content_hash"))


def uncovered_files(changed: DataFrame, links: DataFrame, exclude: str = r"a^") -> DataFrame:
    """Changed files (path) that no page links to, without those that match ``exclude``."""
    files = changed.select("path").distinct().where(~F.col("path").rlike(exclude))
    return files.join(links.select(F.col("target_path").alias("path")), "path", "left_anti").orderBy("path")


def event_stats(events: DataFrame) -> DataFrame:
    """Counts and durations of log events (event, duration_ms) by name."""
    return events.groupBy("event").agg(F.count("*").alias("n"), F.round(F.sum("duration_ms"), 3).alias("total_ms"), F.round(F.avg("duration_ms"), 3).alias("mean_ms"), F.round(F.max("duration_ms"), 3).alias("max_ms"))


def diagnostics_text(findings: DataFrame) -> DataFrame:
    """(value): findings as text lines."""
    return findings.select(F.concat(F.lit("Error: "), T.title_case("kind"), F.lit("\n"), F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit("\n"), F.col("message")).alias("value"))
