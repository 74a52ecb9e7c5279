"""Markdown structure: links, headings, sections.  Native expressions and windows only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import col, github_slug, strip

LINK = r"\[([^\[\]]*)\]\(([^)]*)\)"
SCHEME = r"^[a-zA-Z][a-zA-Z0-9+\-.]*:"

#: What is no content: comments, fenced blocks and inline code, in this order of preference.
NON_CONTENT = "|".join([
    r"<!(?=--)[\s\S]*?(?:-->|\z)",
    r"(?<![^\n])(?:(`{3,}+)|(~{3,}+))[^\n]*+(?:\n|\z)(?:[\s\S]*?(?<=\n)(?:\1|\2) *+(?:\n|\z)|[\s\S]*\z)",
    r"(?:\G|(?<!`))`{3,}+",
    r"``(?!`)[\s\S]*?``",
    r"`(?!`)[^`]*`",
])


#: A page without any of these has content alone.
MARKS = ("`", "~~~", "<!--")

#: Links whose lengths are summed together where places are computed.
CHUNK = 64


def _blank(part: Column) -> Column:
    """As many blanks as bytes, line by line."""
    return F.array_join(F.transform(F.split(part, "\n", -1), lambda x: F.repeat(F.lit(" "), F.octet_length(x))), "\n")


def scrub(content: Column | str) -> Column:
    """The page with all that is no content blanked out, byte for byte, so that places stay the same.

    Most pages have no mark and are not searched.
    """
    text = col(content)
    found, gaps = F.regexp_extract_all(text, F.lit(NON_CONTENT), F.lit(0)), F.split(text, NON_CONTENT, -1)
    open_fence = F.regexp_extract(text, r"(?<![^\n])(`{3,})\z", 1)

    def blanked(part: Column, i: Column) -> Column:
        inline = F.regexp_extract(part, "^(``?)", 1)
        body = F.substr(part, F.length(inline) + 1, F.length(part) - 2 * F.length(inline))
        ticks = part.rlike(r"\A`{3,}\z") & ~((i == F.size(found) - 1) & (part == open_fence))
        return F.when(ticks, part).when(part.rlike("^``?(?!`)"), F.concat(inline, _blank(body), inline)).otherwise(_blank(part))

    pieces = F.zip_with(gaps, F.transform(found, blanked), lambda g, p: F.concat(g, F.coalesce(p, F.lit(""))))
    return F.when(reduce(Column.__or__, [F.contains(text, F.lit(m)) for m in MARKS]), F.array_join(pieces, "")).otherwise(text)


def line_range(fragment: Column | str) -> tuple[Column, Column]:
    """Start and end of ``L10``, ``L10-L20`` or ``L10-20``; null without. What follows the first foreign character is not looked at."""
    text = F.regexp_extract(strip(fragment), "^[0-9Ll-]*", 0)
    rule = r"^[Ll]([0-9]+)(?:-[Ll]*([0-9]+))?$"
    open_ = r"^[Ll]([0-9]+)-"
    start = F.coalesce(F.nullif(F.regexp_extract(text, rule, 1), F.lit("")), F.nullif(F.regexp_extract(text, open_, 1), F.lit("")))
    return start.try_cast("int"), F.nullif(F.regexp_extract(text, rule, 2), F.lit("")).try_cast("int")


def links(pages: DataFrame) -> DataFrame:
    """All links of pages (path, content), one row each, images too, in order.

    Columns: path, ordinal, kind, target (href without fragment), fragment, start_line, end_line, text,
    href, source_line, byte_start and byte_end of the href.  Links are found in scrubbed text and
    read from the page at the same bytes.
    """
    rows = pages.select("path", F.encode("content", "UTF-8").alias("raw"), scrub("content").alias("clean"))
    # no filter by what was found: it would be pushed below, where text and links are made for it a second time
    rows = rows.select("path", "raw", "clean", F.regexp_extract_all("clean", F.lit(LINK), F.lit(0)).alias("found"))
    gaps = F.when(F.size("found") > 0, F.split("clean", LINK, -1)).otherwise(F.array().cast("array<string>"))
    measured = lambda a: F.transform(a, lambda x: F.struct(F.octet_length(x).alias("bytes"), (F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))).alias("breaks")))
    rows = rows.select("path", "raw", "found", gaps.alias("gaps")).select("path", "raw", "found", measured("gaps").alias("g"), measured("found").alias("f"))
    # a link's place is the sum of what stands before it: of whole chunks, which are summed once, and of the rest of its own
    piece = lambda name: F.zip_with(F.slice("g", F.lit(1), F.size("f")), "f", lambda g, f: g[name] + f[name])
    rows = rows.withColumns({f"{name}_of": piece(name) for name in ("bytes", "breaks")})
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + x)
    chunks = lambda name: F.transform(F.sequence(F.lit(0), F.floor((F.size("f") - 1) / CHUNK).cast("int")), lambda c: total(F.slice(f"{name}_of", c * CHUNK + 1, F.lit(CHUNK))))
    rows = rows.withColumns({f"{name}_chunks": chunks(name) for name in ("bytes", "breaks")})
    upto = lambda name: F.transform(f"{name}_chunks", lambda x, c: total(F.slice(f"{name}_chunks", F.lit(1), c)))
    rows = rows.withColumns({f"{name}_upto": upto(name) for name in ("bytes", "breaks")})

    def before(i: Column, name: str) -> Column:
        chunk = F.floor(i / CHUNK).cast("int")
        return F.get(f"{name}_upto", chunk) + total(F.slice(f"{name}_of", chunk * CHUNK + 1, i - chunk * CHUNK)) + F.get("g", i)[name]

    sizes = lambda m: [F.octet_length(F.regexp_extract(m, LINK, k)) for k in (1, 2)]
    # places come from the scrubbed text, words from the page itself
    places = F.transform("found", lambda m, i: F.struct(i.alias("ordinal"), before(i, "bytes").alias("start"), (before(i, "breaks") + 1).alias("source_line"), sizes(m)[0].alias("text_size"), sizes(m)[1].alias("href_size")))
    rows = rows.select("path", "raw", places.alias("places"))
    cut = lambda at, size: F.decode(F.substr("raw", at + 1, size), "UTF-8")
    read = F.transform("places", lambda p: F.struct(p["ordinal"].alias("ordinal"), p["source_line"].alias("source_line"), cut(p["start"] + 1, p["text_size"]).alias("text"), cut(p["start"] + p["text_size"] + 3, p["href_size"]).alias("href"), (p["start"] + p["text_size"] + 3).alias("byte_start"), (p["start"] + p["text_size"] + 3 + p["href_size"]).alias("byte_end")))
    rows = rows.select("path", F.explode(read).alias("l")).select("path", "l.*")
    fragment = F.when(F.contains("href", F.lit("#")), F.regexp_extract("href", "(?s)^[^#]*#(.*)$", 1))
    rows = rows.withColumns({"kind": F.when(F.col("href").rlike(SCHEME), "external").otherwise("internal"), "target": F.regexp_extract("href", "(?s)^[^#]*", 0), "fragment": fragment})
    start, end = line_range("fragment")
    return rows.select("path", "ordinal", "kind", "target", "fragment", start.alias("start_line"), F.when(start.isNotNull(), end).alias("end_line"), "text", "href", "source_line", "byte_start", "byte_end")


def page_lines(pages: DataFrame, text: str = "content") -> DataFrame:
    """(path, line, text) from 1, as split at line breaks."""
    return pages.select("path", F.posexplode(F.split(text, "\n", -1)).alias("line", "text")).select("path", (F.col("line") + 1).alias("line"), "text")


def headings(pages: DataFrame) -> DataFrame:
    """(path, line, level, text, slug) of all headings at the start of a line; repeated slugs are numbered.

    Fences are not looked at here, as links to headings do not either.
    """
    rule = r"^(#{1,6}) (.*?)\r?$"
    rows = page_lines(pages).where(F.col("text").rlike(r"^#{1,6} "))
    rows = rows.select("path", "line", F.length(F.regexp_extract("text", rule, 1)).alias("level"), strip(F.regexp_extract("text", rule, 2)).alias("text"))
    rows = rows.withColumn("base", github_slug("text"))
    before = F.row_number().over(Window.partitionBy("path", "base").orderBy("line")) - 1
    return rows.select("path", "line", "level", "text", F.when(before == 0, F.col("base")).otherwise(F.concat_ws("-", "base", before.cast("string"))).alias("slug"))


def heading_positions(found: DataFrame) -> DataFrame:
    """Adds depth, parent_slug and sibling_index, the place of a heading in the outline."""
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    # for each level the last heading, alive unless a heading of a lesser level came after it
    last = [F.last(F.when(F.col("level") == n, F.struct("line", "slug")), ignorenulls=True).over(order) for n in range(1, 6)]
    cut = [F.max(F.when(F.col("level") < n, F.col("line"))).over(order) for n in range(1, 6)]
    alive = [F.when((F.col("level") > n) & (x["line"] > F.coalesce(c, F.lit(0))), x["slug"]) for n, x, c in zip(range(1, 6), last, cut, strict=True)]
    rows = found.withColumns({"depth": F.col("level"), "parent_slug": F.coalesce(*alive[::-1], F.lit(""))})
    place = Window.partitionBy("path", "depth", "parent_slug").orderBy("line")
    return rows.withColumn("sibling_index", F.row_number().over(place) - 1)


def outline_lines(pages: DataFrame) -> DataFrame:
    """Each line with its heading for proposals: fences are looked at, indents allowed, marks in the text dropped.

    Columns: path, line, text, blank, level and heading (null where the line is none).
    """
    both = pages.select("path", F.posexplode(F.arrays_zip(F.split("content", "\n", -1).alias("raw"), F.split(scrub("content"), "\n", -1).alias("clean"))).alias("line", "x"))
    rows = both.select("path", (F.col("line") + 1).alias("line"), F.col("x.raw").alias("text"), F.col("x.clean").alias("clean"))
    fence = F.col("text").rlike(r"(?U)^\s*(```|~~~)")
    rule = r"(?Us)^\s*(#{1,6})\s+(.*)$"
    title = strip(F.regexp_extract("text", rule, 2))
    may_head = ~fence & (strip("clean") != "") & F.col("text").rlike(rule) & (title != "")
    # what is known of a line alone comes first, so that texts do not go through the window for a caller who needs none
    rows = rows.select("path", "line", "text", (strip("text") == "").alias("blank"), fence.cast("int").alias("fence"), F.when(may_head, F.length(F.regexp_extract("text", rule, 1))).alias("level"), F.when(may_head, strip(F.regexp_replace(title, r"[`*_\[\]]", ""))).alias("heading"))
    inside = F.sum("fence").over(Window.partitionBy("path").orderBy("line")) % 2 == 1
    return rows.withColumn("inside", inside).select("path", "line", "text", "blank", *[F.when(~F.col("inside"), F.col(c)).alias(c) for c in ("level", "heading")])


def sections(outline: DataFrame) -> DataFrame:
    """For each line the chain of headings in force before it and the bounds of its section.

    With a heading in force the section runs from the deepest one to the line before the next heading
    of any level, without blank lines at its end; else it is the paragraph around the line.
    """
    by_line = Window.partitionBy("path").orderBy("line")
    before = by_line.rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == n, F.struct("line", "heading")), ignorenulls=True).over(before) for n in range(1, 7)]
    cut = [F.max(F.when(F.col("level") < n, F.col("line"))).over(before) for n in range(1, 7)]
    chain = F.filter(F.array(*[F.when(x["line"] > F.coalesce(c, F.lit(0)), x) for x, c in zip(last, cut, strict=True)]), lambda x: x.isNotNull())
    rows = outline.withColumns({
        "chain": chain,
        "at": F.coalesce(F.max(F.when(F.col("level").isNotNull(), F.col("line"))).over(before), F.lit(0)),
        "bound": F.sum((F.col("blank") | F.col("level").isNotNull()).cast("int")).over(by_line),
    })
    section = Window.partitionBy("path", "at")
    rows = rows.withColumns({
        "last_text": F.max(F.when(~F.col("blank"), F.col("line"))).over(section),
        "next_heading": F.max(F.when(F.col("level").isNotNull(), F.col("line"))).over(section),
    })
    # the line of the next heading belongs to the section before it; it is not part of its bounds
    content = F.max(F.when(~F.col("blank") & F.col("level").isNull(), F.col("line"))).over(section)
    para = Window.partitionBy("path", "bound")
    own = F.col("blank") | F.col("level").isNotNull()
    low = F.min(F.when(~own, F.col("line"))).over(para)
    high = F.max(F.when(~own, F.col("line"))).over(para)
    # a link on a heading or blank line starts a paragraph with what follows it
    deepest = F.element_at("chain", -1)
    has = F.size("chain") > 0
    rows = rows.withColumns({"content_end": content, "low": low, "high": high})
    return rows.select(
        "path",
        "line",
        F.transform("chain", lambda x: x["heading"]).alias("heading_chain"),
        F.when(has, deepest["heading"]).otherwise("").alias("section_heading"),
        F.when(has, deepest["line"]).otherwise(F.when(own, F.col("line")).otherwise(F.col("low"))).alias("section_start"),
        F.when(has, F.greatest(deepest["line"], F.coalesce("content_end", F.lit(0)))).otherwise(F.coalesce(F.greatest("line", "high"), F.col("line"))).alias("section_end"),
    )
