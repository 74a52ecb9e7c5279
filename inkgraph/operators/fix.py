"""Repair plans: fixes and skipped findings as DataFrames, and the patched pages.

Fixes have file, line, kind, byte_start, byte_end, old_href, new_href, reason, confidence;
skipped findings have file, line, kind, reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frontmatter as fm
from ..functions import markdown as md
from ..functions import text as T
from ..sources.tables import written
from .check import checked_links, directories


def rename_closure(renames: DataFrame) -> DataFrame:
    """(old, new) of all chains of renames (old, new).  A path that was renamed on keeps its steps, as all are successors.

    Chains are doubled each round and a round is written, so a chain of n renames takes log n rounds; cycles end
    when nothing is added.
    """
    known = written(renames.select("old", "new").where("old <> new").distinct(), "renames")
    count = known.count()
    while True:
        step = known.join(known.select(F.col("old").alias("new"), F.col("new").alias("next")), "new").select("old", F.col("next").alias("new"))
        known = written(known.union(step).where("old <> new").distinct(), "renames")
        now = known.count()
        if now == count:
            return known
        count = now


def successors(renames: DataFrame, terminal_only: bool = False) -> DataFrame:
    """(old, candidates): all paths that ``old`` became; with ``terminal_only`` those that were not renamed again."""
    closure = rename_closure(renames)
    if terminal_only:
        closure = closure.join(renames.select(F.col("old").alias("new")).distinct(), "new", "left_anti")
    return closure.groupBy("old").agg(F.sort_array(F.collect_set("new")).alias("candidates"))


def _fix(kind: str, confidence: str, new_href: Column, reason: Column) -> list[Column]:
    return [F.col("path").alias("file"), F.col("source_line").cast("int").alias("line"), F.lit(kind).alias("kind"), "byte_start", "byte_end", F.col("href").alias("old_href"), new_href.alias("new_href"), reason.alias("reason"), F.lit(confidence).alias("confidence")]


def _skip(kind: str, reason: Column) -> list[Column]:
    return [F.col("path").alias("file"), F.col("source_line").cast("int").alias("line"), F.lit(kind).alias("kind"), reason.alias("reason")]


def plan_renames(links: DataFrame, paths: DataFrame, renames: DataFrame, terminal_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Fixes for links whose target was renamed: it is gone, is not bare, and has one successor, which exists."""
    kind = "broken_link_rename"
    known = paths.select("path").union(directories(paths)).distinct()
    missing = checked_links(links).join(known.withColumnRenamed("path", "resolved"), "resolved", "left_anti")
    rows = missing.join(successors(renames, terminal_only).withColumnRenamed("old", "resolved"), "resolved", "left")
    rows = rows.withColumn("next", F.when(F.size("candidates") == 1, F.col("candidates")[0]))
    rows = rows.join(paths.select(F.col("path").alias("next"), F.lit(True).alias("there")), "next", "left")
    why = (
        F.when(T.is_bare("target"), "bare path; manual review")
        .when(F.col("candidates").isNull(), "target deleted; no successor")
        .when(F.size("candidates") > 1, F.concat(F.lit("ambiguous rename: "), F.array_join("candidates", ", ")))
        .when(F.col("there").isNull(), F.concat(F.lit("target deleted; no successor (rename destination "), F.col("next"), F.lit(" missing)")))
    )
    rows = rows.withColumn("why", why)
    fixes = rows.where("why is null").select(*_fix(kind, "high", T.rewritten_href("href", "next", "path"), F.concat(F.lit("renamed to "), F.col("next"))))
    return fixes, rows.where("why is not null").select(*_skip(kind, F.col("why")))


def _broken_anchors(links: DataFrame, targets: DataFrame, found: DataFrame) -> DataFrame:
    """Links to a heading that their target, which is there, has not."""
    rows = checked_links(links).where("start_line is null and fragment <> ''").withColumn("slug", T.github_slug("fragment"))
    rows = rows.join(targets.where("content is not null").select(F.col("path").alias("resolved")), "resolved", "left_semi")
    return rows.join(found.select(F.col("path").alias("resolved"), "slug").distinct(), ["resolved", "slug"], "left_anti")


def plan_aliases(links: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fixes for anchors that name an alias of their target: they are led to the title's heading, the first of level 1, or the first."""
    kind = "alias_to_canonical"
    found = md.headings(targets)
    broken = _broken_anchors(links, targets, found)
    pages = targets.where("content is not null").select(F.col("path").alias("resolved"), fm.parse_frontmatter("content").alias("f")).where(fm.is_member(F.col("f")))
    pages = pages.select("resolved", F.col("f.title").alias("title"), F.explode(F.array_distinct(F.transform("f.aliases", T.github_slug))).alias("slug"))
    rows = broken.join(pages, ["resolved", "slug"])
    first = found.groupBy(F.col("path").alias("resolved")).agg(F.min_by(F.when(F.col("level") == 1, F.col("slug")), F.when(F.col("level") == 1, F.col("line"))).alias("h1"), F.min_by("slug", "line").alias("any"), F.collect_set("slug").alias("slugs"))
    rows = rows.join(first, "resolved", "left").withColumn("title_slug", T.github_slug("title"))
    by_title = F.array_contains("slugs", F.col("title_slug"))
    rows = rows.withColumns({"canonical": F.when(by_title, F.col("title_slug")).otherwise(F.coalesce("h1", "any")), "label": F.when(by_title, "title").when(F.col("h1").isNotNull(), "first H1").otherwise("first heading")})
    reason = F.concat(F.lit("anchor `"), F.col("fragment"), F.lit("` is an alias for title `"), F.col("title"), F.lit("`; rewriting to canonical slug `"), F.col("canonical"), F.lit("` ("), F.col("label"), F.lit(")"))
    fixes = rows.where("canonical is not null").select(*_fix(kind, "high", F.concat("target", F.lit("#"), "canonical"), reason))
    none = F.concat(F.lit("alias `"), F.col("fragment"), F.lit("` listed but target has no headings (tried title slug `"), F.col("title_slug"), F.lit("`, first H1, first heading)"))
    return fixes, rows.where("canonical is null").select(*_skip(kind, none))


def plan_shifts(links: DataFrame, anchors: DataFrame, drift: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fixes for line ranges that a mesh says have moved.

    ``drift`` has code, mesh, path, start_line, end_line and new_path, new_start, new_end.  A mesh with a changed
    anchor is left alone; the mesh must also cover the page and the range's target.
    """
    kind = "mesh_anchor_shift"
    changed = drift.where("code = 'CHANGED'").select("mesh").distinct()
    moved = drift.where("code = 'MOVED'").join(changed, "mesh", "left_anti")
    rows = checked_links(links).where("start_line is not null").withColumn("stop", F.coalesce("end_line", "start_line"))
    moved = moved.select("mesh", F.col("path").alias("resolved"), F.col("start_line"), F.col("end_line").alias("stop"), "new_path", "new_start", "new_end")
    rows = rows.drop("end_line").join(moved, ["resolved", "start_line", "stop"])
    pages = anchors.select("mesh", "path", F.lit(True).alias("covered")).distinct()
    rows = rows.join(pages, ["mesh", "path"], "left")
    one = rows.groupBy("path", "source_line", "byte_start", "byte_end", "href").agg(F.min_by(F.struct("covered", "mesh", "new_path", "new_start", "new_end", "resolved", "target"), F.struct(F.col("covered").isNull(), "mesh")).alias("m")).select("*", "m.*").drop("m")
    span = F.concat(F.lit("#L"), F.col("new_start").cast("string"), F.lit("-L"), F.col("new_end").cast("string"))
    where = F.when(F.col("new_path") == F.col("resolved"), F.col("target")).when(F.col("href").startswith("/"), F.concat(F.lit("/"), F.col("new_path"))).otherwise(T.relative_href("new_path", "path"))
    fixes = one.where("covered").select(*_fix(kind, "high", F.concat(where, span), F.concat(F.lit("anchor moved in mesh "), F.col("mesh"))))
    return fixes, one.where("covered is null").select(*_skip(kind, F.concat(F.lit("mesh "), F.col("mesh"), F.lit(" does not cover the page"))))


#: Most revisions of a page that are searched for a heading.
HISTORY = 100


def plan_headings(links: DataFrame, targets: DataFrame, revisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fixes for anchors whose heading was renamed in place.

    ``revisions`` (path, ord, content) holds older versions, newest first.  The newest of at most 100 that has the slug
    gives its place in the outline; a single heading at that place today is its successor.  Anchors that name an
    alias are not handled here.
    """
    kind = "heading_rename"
    found = md.headings(targets)
    broken = _broken_anchors(links, targets, found)
    aliases = targets.where("content is not null").select(F.col("path").alias("resolved"), fm.parse_frontmatter("content").alias("f")).where(fm.is_member(F.col("f"))).select("resolved", F.explode(F.transform("f.aliases", T.github_slug)).alias("slug"))
    broken = broken.join(aliases, ["resolved", "slug"], "left_anti")
    wanted = broken.select("resolved", "slug").distinct()
    old = revisions.where(F.col("ord") < HISTORY).join(wanted.select(F.col("resolved").alias("path")).distinct(), "path", "left_semi")
    old = old.select(F.concat_ws("\0", F.col("path"), F.col("ord").cast("string")).alias("path"), "content")
    old = md.heading_positions(md.headings(old)).withColumns({"resolved": F.split("path", "\0")[0], "ord": F.split("path", "\0")[1].cast("int")})
    base = old.join(wanted, ["resolved", "slug"], "left_semi").groupBy("resolved", "slug").agg(F.min_by(F.struct("depth", "parent_slug", "sibling_index"), F.struct("ord", "line")).alias("p"))
    now = md.heading_positions(found).select(F.col("path").alias("resolved"), "depth", "parent_slug", "sibling_index", F.col("slug").alias("now"))
    at = base.select("resolved", "slug", "p.*").join(now, ["resolved", "depth", "parent_slug", "sibling_index"], "left").groupBy("resolved", "slug").agg(F.sort_array(F.collect_list("now")).alias("now"))
    rows = broken.join(at, ["resolved", "slug"], "left")
    why = (
        F.when(F.col("now").isNull(), F.concat(F.lit("heading `#"), F.col("fragment"), F.lit("` not found in any revision")))
        .when(F.size("now") == 0, F.concat(F.lit("heading `#"), F.col("fragment"), F.lit("` deleted")))
        .when(F.size("now") > 1, F.concat(F.lit("heading split: "), F.array_join("now", ", ")))
    )
    rows = rows.withColumn("why", why)
    to = F.get("now", F.lit(0))
    fixes = rows.where("why is null").select(*_fix(kind, "medium", F.concat("target", F.lit("#"), to), F.concat(F.lit("heading renamed to `#"), to, F.lit("`"))))
    return fixes, rows.where("why is not null").select(*_skip(kind, F.col("why")))


#: The order in which plans are made; a later one sees the pages as the earlier left them.
ORDER = ("broken_link_rename", "alias_to_canonical", "mesh_anchor_shift", "heading_rename")


def apply_fixes(pages: DataFrame, fixes: DataFrame) -> DataFrame:
    """(path, content) of all pages with the hrefs at the fixes' bytes replaced; overlapping fixes are cut to the first kind."""
    best = fixes.groupBy("file", "byte_start", "byte_end").agg(F.min_by("new_href", F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind"))).alias("new_href"))
    edits = best.groupBy(F.col("file").alias("path")).agg(F.sort_array(F.collect_list(F.struct("byte_start", "byte_end", "new_href"))).alias("edits"))
    rows = pages.select("path", "content").join(edits, "path", "left")
    raw = F.encode("content", "UTF-8")
    cut = lambda a, b: F.decode(F.substr(raw, a + 1, b - a), "UTF-8")
    pieces = F.transform("edits", lambda e, i: F.concat(cut(F.coalesce(F.get("edits", i - 1)["byte_end"], F.lit(0)), e["byte_start"]), e["new_href"]))
    tail = cut(F.element_at("edits", -1)["byte_end"], F.octet_length("content"))
    return rows.select("path", F.when(F.col("edits").isNull(), F.col("content")).otherwise(F.concat(F.array_join(pieces, ""), tail)).alias("content"))


def fix(pages: DataFrame, paths: DataFrame, renames: DataFrame, revisions: DataFrame, anchors: DataFrame | None = None, drift: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fixes, skipped, patched pages): all four plans in order, each over the pages as patched so far."""
    all_fixes = all_skips = None
    steps = [lambda links, p: plan_renames(links, paths, renames), lambda links, p: plan_aliases(links, p)]
    if anchors is not None and drift is not None:
        steps.append(lambda links, p: plan_shifts(links, anchors, drift))
    steps.append(lambda links, p: plan_headings(links, p, revisions))
    links = written(md.links(pages), "links")
    for step in steps:
        fixes, skips = step(links, pages)
        fixes, skips = written(fixes, "fixes"), written(skips, "skips")
        if not fixes.isEmpty():  # else pages and links stay as they are
            pages = written(apply_fixes(pages, fixes), "patched")
            links = written(md.links(pages), "links")
        all_fixes = fixes if all_fixes is None else all_fixes.unionByName(fixes)
        all_skips = skips if all_skips is None else all_skips.unionByName(skips)
    return all_fixes, all_skips, pages
