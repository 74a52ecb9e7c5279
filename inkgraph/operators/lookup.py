"""Lookup, listing and link-graph queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .search import SNIPPETS, line_snippet, suggest


def lookup_keys(corpus: DataFrame) -> DataFrame:
    """(key, path_rel, raw, kind): titles and aliases, each key held by its first page in the order of paths.

    A page's alias that is its own title is no key of its own.
    """
    rows = key_rows(corpus)
    first = Window.partitionBy("key").orderBy("path_rel", "place")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").select("key", "path_rel", "raw", "kind")


def key_rows(corpus: DataFrame) -> DataFrame:
    """(path_rel, place, key, raw, kind) of all titles and aliases, without a page's repeats."""
    title = F.struct(F.lit(0).alias("place"), F.col("title").alias("raw"), F.lit("title").alias("kind"))
    aliases = F.transform(F.coalesce("aliases", F.array()), lambda a, i: F.struct((i + 1).alias("place"), a.alias("raw"), F.lit("alias").alias("kind")))
    rows = corpus.select("path_rel", F.explode(F.concat(F.array(title), aliases)).alias("k")).select("path_rel", "k.*").withColumn("key", T.key_of("raw"))
    once = Window.partitionBy("path_rel", "key").orderBy("place")
    return rows.withColumn("n", F.row_number().over(once)).where("n = 1").drop("n")


def resolve_pages(corpus: DataFrame, inputs: DataFrame, cwd: str = "") -> DataFrame:
    """(input, path_rel, title, alias) for a batch of inputs (input string): paths first from cwd, then from the top, else keys.

    ``alias`` is set where an alias led to the page.  Inputs without a page are left out.
    """
    paths = inputs.where(T.looks_like_path("input")).select("input", F.posexplode(F.array(T.normal_path(F.concat(F.lit(cwd + "/"), F.col("input"))), T.normal_path("input"))).alias("priority", "path_rel"))
    by_path = paths.join(corpus.select("path_rel", "title"), "path_rel").select("input", "priority", "path_rel", "title", F.lit(None).cast("string").alias("alias"))
    keys = inputs.where(~T.looks_like_path("input")).select("input", T.key_of("input").alias("key"))
    found = keys.join(lookup_keys(corpus), "key").join(corpus.select("path_rel", "title"), "path_rel")
    by_key = found.select("input", F.lit(0).alias("priority"), "path_rel", "title", F.when(F.col("kind") == "alias", F.col("raw")).alias("alias"))
    best = by_path.unionByName(by_key).groupBy("input").agg(F.min_by(F.struct("path_rel", "title", "alias"), F.struct("priority", "path_rel")).alias("p"))
    return best.select("input", "p.*")


def list_pages(corpus: DataFrame, tag: str | None = None) -> DataFrame:
    """(title, path_rel, summary, aliases, tags) in the order of titles; aliases by key and tags by key."""
    rows = corpus if tag is None else corpus.where(F.exists("tags", lambda t: T.key_of(t) == tag.lower()))
    by_key = lambda name: F.transform(F.array_sort(F.transform(F.coalesce(name, F.array()), lambda x: F.struct(T.key_of(x).alias("k"), x.alias("x")))), lambda s: s["x"]).alias(name)
    return rows.select("title", "path_rel", "summary", by_key("aliases"), by_key("tags")).orderBy("title", "path_rel")


def backlinks(corpus: DataFrame, links: DataFrame, target: str) -> DataFrame:
    """(title, path_rel, snippets): pages that link to ``target``, by title, with at most three distinct line snippets each.

    ``links`` has source_file, source_line, target_path.
    """
    hits = links.where(F.col("target_path") == target).select(F.col("source_file").alias("path_rel"), "source_line")
    rows = corpus.select("path_rel", "title", "content").join(hits, "path_rel").withColumn("text", line_snippet("content", "source_line"))
    rows = rows.groupBy("title", "text").agg(F.min(F.struct("path_rel", "source_line")).alias("at"))
    # a link from a blank line has no snippet and takes no place among them
    order = Window.partitionBy("title").orderBy(F.col("text").isNull(), F.col("at.path_rel"), F.col("at.source_line"))
    rows = rows.withColumn("n", F.row_number().over(order))
    kept = F.sort_array(F.collect_list(F.when((F.col("n") <= SNIPPETS) & F.col("text").isNotNull(), F.struct("n", F.col("at.source_line").alias("line"), "text"))))
    out = rows.groupBy("title").agg(F.min("at.path_rel").alias("path_rel"), kept.alias("s"))
    return out.select("title", "path_rel", F.transform("s", lambda x: F.struct(x["line"].alias("line"), x["text"].alias("text"))).alias("snippets")).orderBy("title")


def refs(corpus: DataFrame, links: DataFrame, page: str) -> DataFrame:
    """(source_file, source_title, line, text): backlinks of a page, one row for each snippet; an unknown page has none."""
    spark = corpus.sparkSession
    known = resolve_pages(corpus, one_input(spark, page)).select(F.col("path_rel").alias("target_path"))
    hits = links.join(F.broadcast(known), "target_path").select(F.col("source_file"), "source_line")
    rows = corpus.select(F.col("path_rel").alias("source_file"), F.col("title").alias("source_title"), "content").join(hits, "source_file")
    rows = rows.withColumn("text", line_snippet("content", "source_line")).where("text is not null")
    rows = rows.groupBy("source_title", "text").agg(F.min(F.struct("source_file", "source_line")).alias("at"))
    order = Window.partitionBy("source_title").orderBy(F.col("at.source_file"), F.col("at.source_line"))
    rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SNIPPETS)
    return rows.select(F.col("at.source_file").alias("source_file"), "source_title", F.col("at.source_line").alias("line"), "text")


def one_input(spark: SparkSession, text: str) -> DataFrame:
    return spark.range(1).select(F.lit(text).alias("input"))


def summaries(corpus: DataFrame, inputs: DataFrame) -> DataFrame:
    """(input, title, path_rel, summary, code) of a batch; an input without a page has code 1."""
    found = resolve_pages(corpus, inputs).join(corpus.select("path_rel", "summary"), "path_rel")
    return inputs.join(found, "input", "left").select("input", "title", "path_rel", "summary", F.when(F.col("path_rel").isNull(), 1).otherwise(0).alias("code"))


def summary_or_suggestions(corpus: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """The summary of a page, and the suggestions to show if it has no row."""
    return summaries(corpus, one_input(corpus.sparkSession, text)).where("code = 0"), suggest(corpus, text)


def exit_code(codes: DataFrame, name: str = "code") -> DataFrame:
    """The highest code of all inputs, 0 without any."""
    return codes.agg(F.coalesce(F.max(name), F.lit(0)).alias("code"))


def completions(corpus: DataFrame, paths: DataFrame, page: str) -> DataFrame:
    """(href, label, sort_key): every Markdown file as seen from a page, corpus pages first."""
    rows = paths.where(F.col("path").endswith(".md")).join(corpus.select(F.col("path_rel").alias("path"), "title"), "path", "left")
    href = T.relative_href("path", F.lit(page))
    return rows.select(href.alias("href"), F.coalesce("title", "path").alias("label"), F.when(F.col("title").isNotNull(), F.concat(F.lit("0_"), F.col("title"))).otherwise(F.concat(F.lit("1_"), href)).alias("sort_key")).orderBy("sort_key", "href")


def hover(corpus: DataFrame, links: DataFrame) -> DataFrame:
    """Links (any columns and target_path) with title and summary of their targets."""
    return links.join(corpus.select(F.col("path_rel").alias("target_path"), F.col("title").alias("target_title"), F.col("summary").alias("target_summary")), "target_path")


def moved_hrefs(links: DataFrame, moves: DataFrame) -> DataFrame:
    """New hrefs of all links whose target moved: links (path, href, target_path, byte_start, byte_end), moves (old, new)."""
    rows = links.join(moves, F.col("target_path") == F.col("old"))
    return rows.select("path", "byte_start", "byte_end", F.col("href").alias("old_href"), T.rewritten_href("href", "new", "path").alias("new_href"))


def suffix_path(path: Column | str, paths: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: the longest tail of ``path`` that exists in ``paths`` (path), else null."""
    parts = F.split(T.col(path), "/")
    tails = rows.withColumn("__row", F.xxhash64(T.col(path))).select(T.col(path).alias("__path"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("__i", "__tail")).distinct()
    best = tails.join(paths.select(F.col("path").alias("__tail")), "__tail", "left_semi").groupBy("__path").agg(F.min_by("__tail", "__i").alias(name))
    return rows.join(best, T.col(path) == F.col("__path"), "left").drop("__path")
