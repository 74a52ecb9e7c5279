"""Coverage proposals: one draft for each section with links to line ranges.

Drafts are grouped, merged, made extensions of existing meshes, named and
checked with joins and aggregations.  A slug must differ from those that earlier
drafts have: every draft asks for its best name, a name goes to the first draft
that asks, and the others ask for their next one, all at once in each round.  That
ends as if drafts were named one after the other.  Numbers of one name are ranks,
counted over sorted ranges, so a name that all drafts share is no one's group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frontmatter as fm
from ..functions import markdown as md
from ..functions import text as T
from ..sources.sinks import write_array
from ..sources.tables import written

ANCHOR = "struct<path:string,start_line:int,end_line:int>"


def range_links(pages: DataFrame, locate: DataFrame | None = None) -> DataFrame:
    """Internal links to line ranges with their sections: path, ordinal, anchor, heading_chain, section_heading, section_start, section_end, text, target.

    With ``locate`` (path), a target that does not exist is cut from the left until it does.
    """
    links = md.links(pages).where("kind = 'internal' and start_line is not null").withColumn("resolved", T.resolve_path("target", "path"))
    if locate is not None:
        from .lookup import suffix_path

        links = suffix_path("resolved", locate, links, "tail").withColumn("resolved", F.coalesce("tail", "resolved")).drop("tail")
    anchor = F.struct(F.col("resolved").alias("path"), F.col("start_line").cast("int").alias("start_line"), F.coalesce("end_line", "start_line").cast("int").alias("end_line"))
    at = md.sections(md.outline_lines(pages)).withColumnRenamed("line", "source_line")
    return links.withColumn("anchor", anchor).join(at, ["path", "source_line"])


def noun(heading: Column | str, label: Column | str, target: Column | str) -> Column:
    """Last part of a slug: from the heading, else the link's text, else the target's file name."""
    plain = T.strip(F.regexp_replace(T.col(heading), r"(?U)^[#\s]+", ""))
    stem = F.regexp_replace(F.regexp_extract(T.col(target), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(*[F.nullif(T.kebab(x), F.lit("")) for x in (plain, T.strip(label), stem)], F.lit("anchor"))


def drafts(links: DataFrame) -> DataFrame:
    """One row for each section with such links: page, ord, anchors (section first), heading_chain, noun, subdir.

    Targets come in the order of the page, each once; the first link leads the section.
    """
    rows = links.groupBy("path", "section_start", "section_end").agg(
        F.min("ordinal").alias("ord"),
        F.sort_array(F.collect_list(F.struct("ordinal", "anchor"))).alias("found"),
        F.min_by(F.struct("heading_chain", "section_heading", "text", "target"), "ordinal").alias("lead"),
    )
    own = F.struct(F.col("path").alias("path"), F.col("section_start").cast("int").alias("start_line"), F.col("section_end").cast("int").alias("end_line"))
    return rows.select(F.col("path").alias("page"), "ord", F.concat(F.array(own), F.array_distinct(F.transform("found", lambda x: x["anchor"]))).alias("anchors"), F.col("lead.heading_chain").alias("heading_chain"), noun("lead.section_heading", "lead.text", "lead.target").alias("noun"), T.parent("path").alias("subdir"))


def consolidate(rows: DataFrame) -> DataFrame:
    """Drafts of a page with the same anchors become one, the first; ``merged`` counts them."""
    first = F.min_by(F.struct("heading_chain", "noun", "subdir"), "ord")
    out = rows.groupBy("page", "anchors").agg(F.min("ord").alias("ord"), first.alias("d"), F.count("*").alias("merged"))
    return out.select("page", "ord", "anchors", "d.heading_chain", "d.noun", "d.subdir", "merged")


def trim_chain(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """Drops the first heading of a chain where it is the page's title; ``titles`` has page, title."""
    plain = lambda x: T.strip(F.regexp_replace(F.lower(x), r"(?U)\s+", " "))
    out = rows.join(titles.select("page", "title"), "page", "left")
    same = F.coalesce(plain(F.get("heading_chain", F.lit(0))) == plain(F.col("title")), F.lit(False))
    return out.withColumn("heading_chain", F.when(same, F.slice("heading_chain", F.lit(2), F.size("heading_chain"))).otherwise(F.col("heading_chain")))


def extend(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Drafts of sections that a mesh anchors extend it: what it has is left out, and drafts with nothing new go.

    ``anchors`` has mesh, path, start_line, end_line; of several meshes the least name owns a section.
    """
    own = anchors.groupBy(F.col("path").alias("page"), F.col("start_line").alias("s"), F.col("end_line").alias("e")).agg(F.min("mesh").alias("extends"))
    out = rows.withColumns({"s": F.col("anchors")[0]["start_line"], "e": F.col("anchors")[0]["end_line"]}).join(own, ["page", "s", "e"], "left").drop("s", "e")
    held = out.where("extends is not null").select(F.col("extends").alias("mesh")).distinct().join(anchors, "mesh")
    new = out.where("extends is not null").select("page", "ord", "extends", F.posexplode("anchors").alias("i", "a")).select("page", "ord", F.col("extends").alias("mesh"), "i", "a", F.col("a.path").alias("path"), F.col("a.start_line").alias("start_line"), F.col("a.end_line").alias("end_line"))
    new = new.join(held.select("mesh", "path", "start_line", "end_line").distinct(), ["mesh", "path", "start_line", "end_line"], "left_anti")
    left = new.groupBy("page", "ord").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "a"))), lambda x: x["a"]).alias("rest"))
    out = out.join(left, ["page", "ord"], "left").where("extends is null or rest is not null")
    return out.withColumn("anchors", F.when(F.col("extends").isNotNull(), F.col("rest")).otherwise(F.col("anchors"))).drop("rest")


def _slug(subdir: str, qualifiers: list[str], last: str) -> str:
    parts = dict.fromkeys(["wiki", *filter(None, subdir.split("/")), *filter(None, qualifiers)])
    return "/".join([*parts, last])


def _names(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The names that each draft asks for, in order: base, then more and more of the heading chain, then the title; numbers of the last one follow."""
    for frame in frames:
        names = []
        for r in frame.itertuples():
            chain = [k for h in r.heading_chain if (k := _kebab(h)) and k != r.noun]
            options = [chain[len(chain) - n :] for n in range(len(chain) + 1)]
            title = _kebab(r.title or "")
            if title and title != r.noun:
                options.append([title, *chain])
            names.append(list(dict.fromkeys(_slug(r.subdir, list(q), r.noun) for q in options)))
        yield pd.DataFrame({"page": frame["page"], "ord": frame["ord"], "names": names})


def _kebab(text: str) -> str:
    plain = re.sub(r"^\s*[0-9]+[.)] ", "", text)
    return re.sub("[^a-z0-9]+", "-", plain.lower() if plain.isascii() else "".join(c.lower() if c.isascii() else "-" for c in plain)).strip("-")


def _counted(rows: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """Adds ``nth``: how many rows of a key have ``flag``, up to each row by ``order``; counted within sorted ranges, whose sums are added up."""
    dealt = rows.withColumn("flag", flag.cast("long")).repartitionByRange(key, *order).withColumn("piece", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    # a piece of a key is a row here
    sums = dealt.groupBy(key, "piece").agg(F.sum("flag").alias("own"))
    sums = sums.select(key, "piece", F.coalesce(F.sum("own").over(Window.partitionBy(key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.sum("flag").over(Window.partitionBy(key, "piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("within", within).join(sums, [key, "piece"]).withColumn("nth", F.col("within") + F.col("before")).drop("flag", "piece", "within", "before")


def _numbers(slugs: DataFrame) -> DataFrame:
    """Those of ``slugs`` (slug, ...) that are a number of a name, with base and number."""
    parts = slugs.withColumns({"base": F.regexp_extract("slug", "(?s)^(.*)-[1-9][0-9]*$", 1), "number": F.regexp_extract("slug", "-([1-9][0-9]*)$", 1).try_cast("long")})
    return parts.where("base <> '' and number >= 2")


def _numbered(pool: DataFrame, blocked: DataFrame | None) -> DataFrame:
    """(page, ord, base, number): the drafts of each base in order have its numbers from 2, without those ``blocked`` (base, number)."""
    ranks = _counted(pool, "base", ["page", "ord"], F.lit(1)).withColumn("rank", F.col("nth") - 1).drop("nth")
    if blocked is None:
        return ranks.select("page", "ord", "base", (F.col("rank") + 2).alias("number"))
    # a blocked number is passed by the drafts whose rank is that of its free number, or more
    passed = _counted(blocked, "base", ["number"], F.lit(1)).select("base", (F.col("number") - 1 - F.col("nth")).alias("rank"), F.lit(0).alias("kind"))
    every = passed.unionByName(ranks.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    every = _counted(every, "base", ["rank", "kind"], F.col("kind") == 0).where("kind = 1")
    return every.select("page", "ord", "base", (F.col("rank") + 2 + F.col("nth")).alias("number"))


def name_drafts(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds ``slug``: an extension has its mesh's, all others one that neither a mesh (``existing``: mesh) nor an earlier draft has."""
    meshes = written(existing.select(F.col("mesh").alias("slug")).distinct(), "meshes")
    asking = rows.where("extends is null").select("page", "ord", "heading_chain", "noun", "subdir", "title").mapInPandas(_names, "page string, ord int, names array<string>")
    asking = written(asking.withColumn("at", F.lit(0)), "asking")
    held, pool, numbers = asking.where(F.lit(False)).withColumn("slug", F.lit("")), asking.where(F.lit(False)), None
    mesh_numbers = written(_numbers(meshes).select("base", "number"), "mesh-numbers")
    while True:
        while not asking.isEmpty():
            every = asking.withColumn("slug", F.col("names")[F.col("at")]).unionByName(held)
            first = every.groupBy("slug").agg(F.min(F.struct("page", "ord", "names", "at")).alias("d")).join(meshes, "slug", "left_anti")
            held = written(first.select("d.*", "slug"), "held")
            others = written(every.drop("slug").join(held.select("page", "ord"), ["page", "ord"], "left_anti").withColumn("at", F.col("at") + 1), "asking")
            asking, pool = others.where("at < size(names)"), pool.unionByName(others.where("at >= size(names)"))
        based = written(pool.select("page", "ord", F.element_at("names", -1).alias("base")), "pool")
        if based.isEmpty():
            break
        owners = written(_numbers(held.select("slug", "page", "ord")).select("base", "number", F.struct("page", "ord").alias("owner")).join(based.select("base").distinct(), "base", "left_semi"), "owners")
        blocked, lost = mesh_numbers.join(based.select("base").distinct(), "base", "left_semi"), None
        while True:
            blocked = written(blocked, "blocked")
            numbers = written(_numbered(based, None if blocked.isEmpty() else blocked), "numbers")
            if owners.isEmpty():
                break
            # of numbers that a draft holds as a name of its own the least of each base is settled: the earlier draft has it
            met = numbers.join(owners.join(blocked, ["base", "number"], "left_anti"), ["base", "number"])
            met = met.groupBy("base").agg(F.min(F.struct("number", F.struct("page", "ord").alias("d"), "owner")).alias("m")).select("base", "m.*")
            met = written(met, "met")
            if met.isEmpty():
                break
            lost = met.where("d < owner").select("owner.page", "owner.ord")
            if not lost.isEmpty():
                break
            blocked = blocked.unionByName(met.select("base", "number"))
        if lost is None or lost.isEmpty():
            break
        gone = held.join(lost, ["page", "ord"], "left_semi").drop("slug").withColumn("at", F.col("at") + 1)
        gone, held = written(gone, "asking"), written(held.join(lost, ["page", "ord"], "left_anti"), "held")
        asking, pool = gone.where("at < size(names)"), pool.unionByName(gone.where("at >= size(names)"))
    named = held.select("page", "ord", "slug")
    if numbers is not None:
        named = named.unionByName(numbers.select("page", "ord", F.concat_ws("-", "base", "number").alias("slug")))
    out = rows.join(named, ["page", "ord"], "left")
    return out.withColumn("slug", F.coalesce("extends", "slug"))


def drop_missing(rows: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept drafts, dropped: slug, missing_path, page): a draft goes if one of its anchors but the first has no file."""
    rest = rows.select("page", "ord", "slug", F.posexplode(F.slice("anchors", F.lit(2), F.size("anchors"))).alias("i", "a")).withColumn("path", F.col("a.path"))
    gone = rest.join(paths.select("path"), "path", "left_anti").groupBy("page", "ord", "slug").agg(F.min_by("path", "i").alias("missing_path"))
    return rows.join(gone.select("page", "ord"), ["page", "ord"], "left_anti"), gone.select("slug", "missing_path", "page")


def parse_errors(pages: DataFrame) -> DataFrame:
    """(path, category, message) of pages that no proposals are made for."""
    text = {"empty_title": "frontmatter present but `title:` is empty", "malformed": "malformed frontmatter — could not parse `title`", "unreadable": "file could not be read"}
    rows = pages.select("path", fm.proposal_error("content").alias("category")).where("category is not null")
    return rows.withColumn("message", F.coalesce(*[F.when(F.col("category") == k, F.lit(v)) for k, v in text.items()]))


def scaffold(pages: DataFrame, anchors: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(drafts, dropped, errors) for pages (path, content), given the anchors of existing meshes and the inventory."""
    pages = pages.where(~F.contains("path", F.lit("/tests/fixtures/")))
    titles = pages.select(F.col("path").alias("page"), fm.field_of("content", "title").alias("title"))
    rows = consolidate(drafts(range_links(pages.where("content is not null"), paths)))
    rows = written(extend(trim_chain(rows, titles), anchors), "drafts")
    rows = written(name_drafts(rows, anchors), "named")
    rows, dropped = drop_missing(rows, paths)
    errors = parse_errors(pages)
    return rows.join(errors.select(F.col("path").alias("page")), "page", "left_anti"), dropped, errors


def page_proposals(rows: DataFrame) -> DataFrame:
    """(path, title, meshes): the proposal for each page, its meshes in order."""
    mesh = F.struct("slug", F.col("heading_chain").alias("headingChain"), F.transform("anchors", lambda a: F.struct(a["path"].alias("path"), a["start_line"].alias("startLine"), a["end_line"].alias("endLine"))).alias("anchors"))
    page = rows.groupBy("page").agg(F.first("title").alias("title"), F.sort_array(F.collect_list(F.struct("ord", mesh.alias("m")))).alias("m"))
    return page.select(F.col("page").alias("path"), F.coalesce("title", F.lit("")).alias("title"), F.transform("m", lambda x: x["m"]).alias("meshes"))


def write_json(folder: str, rows: DataFrame, dropped: DataFrame, errors: DataFrame) -> None:
    """A proposal of any size: ordered JSON arrays ``pages``, ``droppedMeshes`` and ``parseErrors`` below ``folder``, each visible only when whole."""
    write_array(f"{folder}/pages", page_proposals(rows), ["path"])
    write_array(f"{folder}/droppedMeshes", dropped.select("slug", F.col("missing_path").alias("missingPath"), "page"), ["slug", "missingPath", "page"])
    write_array(f"{folder}/parseErrors", errors.select("path", "category", "message"), ["path", "category"])


def to_json(rows: DataFrame, dropped: DataFrame, errors: DataFrame) -> DataFrame:
    """One row (value) with a small proposal as JSON, to be shown; ``write_json`` writes one of any size."""
    page = page_proposals(rows).select(F.struct("path", "title", "meshes").alias("p"))
    pages = page.groupBy().agg(F.sort_array(F.collect_list("p")).alias("pages"))
    gone = dropped.groupBy().agg(F.sort_array(F.collect_list(F.struct("slug", F.col("missing_path").alias("missingPath"), "page"))).alias("droppedMeshes"))
    bad = errors.groupBy().agg(F.sort_array(F.collect_list(F.struct("path", "category", "message"))).alias("parseErrors"))
    # three single rows
    return pages.join(F.broadcast(gone)).join(F.broadcast(bad)).select(F.to_json(F.struct(F.lit(1).alias("schemaVersion"), "parseErrors", "droppedMeshes", "pages")).alias("value"))


def to_markdown(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """(page, value): the proposal for each page as Markdown with a shell block for each mesh."""
    span = F.transform("anchors", lambda a: F.concat(F.lit("  '"), a["path"], F.lit("#L"), a["start_line"].cast("string"), F.lit("-L"), a["end_line"].cast("string"), F.lit("'")))
    head = F.when(F.size("heading_chain") > 0, F.concat(F.lit("## "), F.array_join("heading_chain", " → "), F.lit("\n\n"))).otherwise("")
    why = F.when(F.col("extends").isNull(), F.concat(F.lit("git mesh why "), F.col("slug"), F.lit(" -m \"\"\n"))).otherwise("")
    block = F.concat(head, F.lit("```bash\ngit mesh add "), F.col("slug"), F.lit(" \\\n"), F.array_join(span, " \\\n"), F.lit("\n"), why, F.lit("```\n"))
    out = rows.drop("title").withColumn("block", block).groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "block"))), lambda x: x["block"]), "\n").alias("blocks"))
    out = out.join(titles.select("page", "title"), "page", "left")
    name = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("# "), F.col("title"), F.lit(" • "), F.col("page"))).otherwise(F.concat(F.lit("# "), F.col("page")))
    return out.select("page", F.concat(name, F.lit("\n\n"), F.col("blocks")).alias("value"))
