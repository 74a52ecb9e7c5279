"""Integrity rules: each is one DataFrame of (kind, file, line, message); a check is their union.

Existence is tested against an inventory of paths, so a file that is no text is not reported missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frontmatter as fm
from ..functions import markdown as md
from ..functions import text as T
from ..sources.tables import written
from .lookup import key_rows


def _row(kind: str, file: Column | str, line: Column | str, message: Column) -> list[Column]:
    return [F.lit(kind).alias("kind"), T.col(file).alias("file"), (line if isinstance(line, Column) else F.col(line)).cast("int").alias("line"), message.alias("message")]


def unreadable(pages: DataFrame) -> DataFrame:
    """Pages (path, content) without content."""
    return pages.where("content is null").select(*_row("runtime", "path", F.lit(1), F.concat(F.lit("Cannot read `"), F.col("path"), F.lit("`."))))


def frontmatter_errors(pages: DataFrame) -> DataFrame:
    """Pages whose block is missing or does not pass validation."""
    rows = pages.where("content is not null").select("path", fm.parse_frontmatter("content").alias("f"))
    rows = rows.where("f is null or f.error is not null")
    return rows.select(*_row("frontmatter", "path", F.lit(1), F.coalesce("f.message", F.lit("Add frontmatter with `title` and `summary`."))))


def collisions(corpus: DataFrame) -> DataFrame:
    """Keys that an earlier page holds, on the later page.

    The first page of a key is found by one aggregation, so a key in a third of all pages is
    summed up before it is shuffled.
    """
    return keys_taken(key_rows(corpus))


def keys_taken(rows: DataFrame) -> DataFrame:
    """The same for keys that were extracted."""
    first = rows.groupBy("key").agg(F.min("path_rel").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = rows.join(first, "key").where("path_rel > first")
    return later.select(*_row("collision", "path_rel", F.lit(1), F.concat(F.lit("`"), F.col("raw"), F.lit("` is already used by `"), F.col("first"), F.lit("`."))))


def checked_links(links: DataFrame) -> DataFrame:
    """Internal links with the repository path that they lead to."""
    return links.where((F.col("kind") == "internal") & ~F.col("href").startswith("mailto:")).withColumn("resolved", T.resolve_path("target", "path"))


def directories(paths: DataFrame) -> DataFrame:
    """All directories above the paths; the top is the empty path."""
    parts = F.split("path", "/")
    return paths.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("path")).distinct()


def broken_links(links: DataFrame, paths: DataFrame) -> DataFrame:
    """Links to neither a file nor a directory; a bare path that exists from the top is given a hint."""
    known = paths.select("path").union(directories(paths)).distinct()
    missing = checked_links(links).join(known.withColumnRenamed("path", "resolved"), "resolved", "left_anti")
    top = known.select(F.col("path").alias("top"), F.lit(True).alias("there"))
    rows = missing.withColumn("top", F.when(T.is_bare("target"), T.normal_path("target"))).join(top, "top", "left")
    plain = F.concat(F.lit("File `"), F.col("target"), F.lit("` not found."))
    hint = F.concat(F.lit("File `"), F.col("target"), F.lit("` not found at page-relative path.\nIf you meant a repo-relative path, use `/"), F.col("target"), F.lit("` instead."))
    return rows.select(*_row("broken_link", "path", "source_line", F.when(F.coalesce("there", F.lit(False)), hint).otherwise(plain)))


def broken_ranges(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Line ranges that do not fit their targets (path, content): zero, beyond the end, or the wrong way round."""
    return ranges_beyond(links, targets.where("content is not null").select("path", T.line_count("content").alias("n")))


def ranges_beyond(links: DataFrame, sizes: DataFrame) -> DataFrame:
    """The same for targets whose lines (path, n) are counted."""
    rows = checked_links(links).where("start_line is not null").join(sizes.withColumnRenamed("path", "resolved"), "resolved").withColumn("stop", F.coalesce("end_line", "start_line"))
    span = F.concat(F.lit("L"), F.col("start_line").cast("string"), F.lit("–L"), F.col("stop").cast("string"))
    message = (
        F.when(F.col("start_line") == 0, F.concat(F.lit("Line numbers are 1-based. Replace `L0` with `L1` in `"), F.col("target"), F.lit("`.")))
        .when((F.col("start_line") > F.col("n")) | (F.col("stop") > F.col("n")), F.concat(F.lit("Line range `"), span, F.lit("` exceeds `"), F.col("target"), F.lit("` ("), F.col("n").cast("string"), F.lit(" lines).")))
        .when(F.col("start_line") > F.col("stop"), F.concat(F.lit("Line range start (`L"), F.col("start_line").cast("string"), F.lit("`) must not exceed end (`L"), F.col("stop").cast("string"), F.lit("`) in `"), F.col("target"), F.lit("`.")))
    )
    return rows.withColumn("message", message).where("message is not null").select(*_row("broken_anchor", "path", "source_line", F.col("message")))


def broken_headings(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Anchors that are no line range and no heading of their target."""
    return headings_missing(links, targets.where("content is not null").select("path"), md.headings(targets).select("path", "slug").distinct())


def headings_missing(links: DataFrame, texts: DataFrame, slugs: DataFrame) -> DataFrame:
    """The same for targets (path) whose headings (path, slug) are known."""
    rows = checked_links(links).where("start_line is null and fragment <> ''").withColumn("slug", T.github_slug("fragment"))
    rows = rows.join(texts.select(F.col("path").alias("resolved")), "resolved", "left_semi")
    missing = rows.join(slugs.withColumnRenamed("path", "resolved"), ["resolved", "slug"], "left_anti")
    return missing.select(*_row("broken_anchor", "path", "source_line", F.concat(F.lit("Heading `#"), F.col("fragment"), F.lit("` not found in `"), F.col("target"), F.lit("`."))))


def uncovered(links: DataFrame, anchors: DataFrame, paths: DataFrame) -> DataFrame:
    """Links to line ranges that no mesh covers: a mesh covers a link if it anchors the range or the whole file, and the page too.

    ``anchors`` has mesh, path, start_line, end_line; start and end 0 stand for the whole file.
    """
    rows = checked_links(links).where("start_line is not null").join(paths.select(F.col("path").alias("resolved")), "resolved", "left_semi")
    rows = rows.withColumn("stop", F.coalesce("end_line", "start_line"))
    wanted = rows.select("path", "resolved", "start_line", "stop").distinct()
    keyed = wanted.select("*", F.explode(F.array(F.struct(F.col("start_line").alias("s"), F.col("stop").alias("e")), F.struct(F.lit(0).alias("s"), F.lit(0).alias("e")))).alias("k"))
    held = anchors.select("mesh", F.col("path").alias("resolved"), F.col("start_line").alias("s"), F.col("end_line").alias("e")).distinct()
    found = keyed.select("path", "resolved", "start_line", "stop", "k.s", "k.e").join(held, ["resolved", "s", "e"])
    covered = found.join(anchors.select("mesh", "path").distinct(), ["mesh", "path"], "left_semi").select("path", "resolved", "start_line", "stop").distinct()
    missing = rows.join(covered, ["path", "resolved", "start_line", "stop"], "left_anti")
    span = F.concat(F.col("resolved"), F.lit("#L"), F.col("start_line").cast("string"), F.lit("-L"), F.col("stop").cast("string"))
    return missing.select(*_row("mesh_uncovered", "path", "source_line", F.concat(F.lit("Link to `"), span, F.lit("` is not covered by a mesh."))))


def mesh_unavailable(pages: DataFrame) -> DataFrame:
    """The one finding there is where coverage data cannot be had."""
    return pages.sparkSession.range(1).select(*_row("mesh_unavailable", F.lit(""), F.lit(0), F.lit("Coverage data is not available.")))


def check(pages: DataFrame, corpus: DataFrame, paths: DataFrame, anchors: DataFrame | None = None, mesh: bool = True, scope: DataFrame | None = None, targets: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """All findings.  ``scope`` (path) limits which pages are checked; collisions look at the whole corpus all the same.

    ``links`` are those of the pages to check, where they are written already.
    """
    inside = pages if scope is None else pages.join(scope.select("path"), "path", "left_semi")
    if links is None:
        links = written(md.links(inside.where("content is not null")), "links")  # four rules read it
    targets = pages if targets is None else targets
    clash = collisions(corpus)
    if scope is not None:
        clash = clash.join(scope.select(F.col("path").alias("file")), "file", "left_semi").select("kind", "file", "line", "message")
    rules = [unreadable(inside), frontmatter_errors(inside), clash, broken_links(links, paths), broken_ranges(links, targets), broken_headings(links, targets)]
    if mesh:
        rules.append(mesh_unavailable(pages) if anchors is None else uncovered(links, anchors, paths))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def check_code(findings: DataFrame, no_exit_code: bool = False) -> DataFrame:
    """(code): 1 if there is a finding."""
    return findings.agg((F.lit(0) if no_exit_code else F.when(F.count("*") > 0, 1).otherwise(0)).alias("code"))


def hook(pages: DataFrame, corpus: DataFrame, paths: DataFrame, events: DataFrame, **options) -> DataFrame:
    """(systemMessage): what a check of the one Markdown member that an edit event (value: JSON) names has to say; no row if nothing."""
    edited = events.select(F.get_json_object("value", "$.tool_input.file_path").alias("path")).where(F.col("path").endswith(".md"))
    members = pages.where(fm.is_member(fm.parse_frontmatter("content"))).select("path")
    found = check(pages, corpus, paths, scope=edited.join(members, "path", "left_semi").distinct(), **options)
    text = F.concat(T.title_case("kind"), F.lit(": "), F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(": "), F.col("message"))
    joined = found.groupBy().agg(F.array_join(F.sort_array(F.collect_list(text)), "\n").alias("m")).where("m <> ''")
    return joined.select(F.to_json(F.struct(F.col("m").alias("systemMessage"))).alias("value"))
