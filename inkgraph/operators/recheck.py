"""Incremental checks: what the rules read of pages is stored, and after a change only findings that can change are made anew.

A finding depends on its own page, on the files and directories that its link may lead to, on the lines and
headings of its target, on the pages that hold its key, and on the coverage of both ends.  So the pages to check
again are those that changed, those with a link to something that changed, came or went, and those that share a
key with them.  Texts of pages that did not change are not read: their links, headings, lines and keys are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions import text as T
from ..sources.tables import written
from . import check
from .lookup import key_rows


@dataclass(frozen=True)
class Facts:
    """paths (path) of all files; links, slugs (path, slug), sizes (path, n), keys of the pages with text; own findings of pages."""

    paths: DataFrame
    links: DataFrame
    slugs: DataFrame
    sizes: DataFrame
    keys: DataFrame
    own: DataFrame


def facts(pages: DataFrame, corpus: DataFrame, paths: DataFrame) -> Facts:
    """What the rules need of pages (path, content), in written tables."""
    texts = pages.where("content is not null")
    links = md.links(texts).withColumn("resolved", T.resolve_path("target", "path")).withColumn("top", F.when(T.is_bare("target"), T.normal_path("target")))
    found = {
        "paths": paths.select("path").distinct(), "links": links, "slugs": md.headings(texts).select("path", "slug").distinct(),
        "sizes": texts.select("path", T.line_count("content").alias("n")), "keys": key_rows(corpus), "own": check.unreadable(pages).unionByName(check.frontmatter_errors(pages)),
    }
    return Facts(**{k: written(v, f"facts-{k}") for k, v in found.items()})


def findings(known: Facts, anchors: DataFrame | None = None, scope: DataFrame | None = None) -> DataFrame:
    """All findings from facts, or those of the pages ``scope`` (path); with ``anchors`` also of coverage."""
    links, own, keys = known.links, known.own, known.keys
    if scope is not None:
        files = scope.select(F.col("path").alias("file"))
        links, own = links.join(scope, "path", "left_semi"), own.join(files, "file", "left_semi")
        keys = keys.join(keys.join(scope.select(F.col("path").alias("path_rel")), "path_rel", "left_semi").select("key").distinct(), "key", "left_semi")
    links = written(links.drop("resolved", "top"), "scope-links")  # three or four rules read it
    out = own.unionByName(check.broken_links(links, known.paths)).unionByName(check.ranges_beyond(links, known.sizes)).unionByName(check.headings_missing(links, known.sizes, known.slugs))
    if anchors is not None:
        out = out.unionByName(check.uncovered(links, anchors, known.paths))
    clash = check.keys_taken(keys)
    return out.unionByName(clash if scope is None else clash.join(files, "file", "left_semi").select(*out.columns))


def updated(known: Facts, changed: Facts, deleted: DataFrame) -> Facts:
    """The facts after the pages and files of ``changed`` came or changed and the paths ``deleted`` went."""
    gone = deleted.select("path").unionByName(changed.paths).distinct()

    def merged(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
        return written(old.join(gone.withColumnRenamed("path", column), column, "left_anti").select(*new.columns).unionByName(new), "facts")

    return Facts(
        merged(known.paths, changed.paths, "path"), merged(known.links, changed.links, "path"), merged(known.slugs, changed.slugs, "path"),
        merged(known.sizes, changed.sizes, "path"), merged(known.keys, changed.keys, "path_rel"), merged(known.own, changed.own, "file"),
    )


def affected(old: Facts, changed: Facts, deleted: DataFrame, anchors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(path) of the pages whose findings may differ; ``anchors`` are the coverage before and after, where that changed too."""
    touched = changed.paths.unionByName(deleted.select("path")).distinct()
    moved = changed.paths.join(old.paths, "path", "left_anti").unionByName(deleted.select("path").join(changed.paths, "path", "left_anti"))
    if anchors is not None:
        a, b = (x.select("mesh", "path", "start_line", "end_line").distinct() for x in anchors)
        touched = touched.unionByName(a.exceptAll(b).unionByName(b.exceptAll(a)).select("path")).distinct()
    touched = written(touched, "touched")
    targets = touched.unionByName(check.directories(moved)).distinct()  # a directory above may have come or gone
    links = old.links.select("path", "resolved", "top")  # links of changed pages are checked anyway
    near = links.join(targets.withColumnRenamed("path", "resolved"), "resolved", "left_semi").select("path")
    near = near.unionByName(links.join(targets.withColumnRenamed("path", "top"), "top", "left_semi").select("path"))
    held = old.keys.join(touched.withColumnRenamed("path", "path_rel"), "path_rel", "left_semi").select("key").unionByName(changed.keys.select("key")).distinct()
    shared = old.keys.join(held, "key", "left_semi").select(F.col("path_rel").alias("path"))
    return touched.unionByName(near).unionByName(shared).distinct()


def recheck(old: Facts, before: DataFrame, changed: Facts, deleted: DataFrame, anchors: DataFrame | None = None, old_anchors: DataFrame | None = None) -> tuple[Facts, DataFrame]:
    """(facts, findings) after a change, from the findings ``before`` it."""
    both = None if anchors is None or old_anchors is None else (old_anchors, anchors)
    scope = written(affected(old, changed, deleted, both), "recheck-scope")
    now = updated(old, changed, deleted)
    kept = before.join(scope.select(F.col("path").alias("file")), "file", "left_anti").select("kind", "file", "line", "message")
    return now, kept.unionByName(findings(now, anchors, scope))
