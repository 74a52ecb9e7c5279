"""Ranked search over a corpus: exact key, path and full-text tiers, fused by title.

A corpus has path_rel, title, summary, aliases, tags, keywords, body and content.
Ranking is done over narrow rows; page texts are joined to the few rows of the
result alone, where snippets are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.query import Query, parse_query

#: Fixed: weight of each searched field.
WEIGHTS = {"title": 5.0, "aliases": 4.0, "tags": 3.0, "keywords": 3.0, "summary": 2.0, "body": 1.0}
DEFAULT_LIMIT, SUGGEST_LIMIT, SUGGEST_SCORE, SNIPPETS = 3, 3, 0.5, 3
K1, B = 1.2, 0.75


def field_text(name: str) -> Column:
    return F.array_join(name, " ") if name in ("aliases", "tags", "keywords") else F.col(name)


def _units(query: Query) -> list[tuple[str, ...]]:
    """What is ranked: each phrase, and each term outside phrases."""
    return list(dict.fromkeys([*query.phrase_words, *((t,) for t in query.terms)]))


def term_rows(corpus: DataFrame, query: Query, fields: dict[str, float] = WEIGHTS) -> DataFrame:
    """(path_rel, title, field, unit, tf, dl) for every field of every page; tf may be 0.

    One pass over the corpus: a field is cut into words once and only the query's words are counted.
    """
    words = F.array(*[F.struct(F.lit(name).alias("field"), T.terms(F.coalesce(field_text(name), F.lit(""))).alias("w")) for name in fields])
    rows = corpus.select("path_rel", "title", F.explode(words).alias("x")).select("path_rel", "title", F.col("x.field").alias("field"), F.col("x.w").alias("w"))
    units = _units(query)
    padded = F.concat(F.lit(" "), F.array_join("w", "  "), F.lit(" ")) if any(len(u) > 1 for u in units) else F.lit("")
    # a term is counted in the array; of a phrase the words after the first are only looked at, so repeats that overlap count too
    count = [F.size("w") - F.size(F.array_remove("w", u[0])) if len(u) == 1 else F.size(F.split("padded", f" {u[0]} (?={''.join(' ' + w + ' ' for w in u[1:])})", -1)) - 1 for u in units]
    return rows.withColumn("padded", padded).select("path_rel", "title", "field", F.size("w").alias("dl"), F.array(*count).alias("tf"))


def bm25(corpus: DataFrame, query: Query, fields: dict[str, float] = WEIGHTS) -> DataFrame:
    """(path_rel, title, score) of the pages that hold at least one of the query's words or phrases."""
    units = _units(query)
    if not units:
        return corpus.select("path_rel", "title", F.lit(0.0).alias("score")).limit(0)
    rows = term_rows(corpus, query, fields)
    stats = rows.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col("tf")[i] > 0).cast("long")).alias(f"df{i}") for i in range(len(units))])
    rows = rows.where(F.exists("tf", lambda x: x > 0)).join(F.broadcast(stats), "field")  # one row for each field
    weight = F.coalesce(*[F.when(F.col("field") == k, F.lit(v)) for k, v in fields.items()])
    total = F.lit(0.0)
    for i in range(len(units)):
        tf, df = F.col("tf")[i], F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        total = total + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("path_rel", "title").agg(F.sum(weight * total).alias("score"))


def exact_tier(corpus: DataFrame, query: Query) -> DataFrame:
    """Pages whose title or an alias is the query; titles before aliases."""
    keys = corpus.select("path_rel", "title", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("kind"), T.key_of("title").alias("key"))), F.transform(F.coalesce("aliases", F.array()), lambda a: F.struct(F.lit(1).alias("kind"), T.key_of(a).alias("key"))))).alias("k"))
    return keys.where(F.col("k.key") == query.text).groupBy("path_rel", "title").agg(F.min("k.kind").cast("double").alias("rank"))


def path_tier(corpus: DataFrame, query: Query, root: str = "") -> DataFrame:
    """Pages with all tokens in their path, relative or absolute."""
    where = F.lower(F.concat_ws(" ", "path_rel", F.concat(F.lit(root + "/"), F.col("path_rel"))))
    hit = F.lit(bool(query.tokens))
    for t in query.tokens:
        hit = hit & F.contains(where, F.lit(t))
    return corpus.where(hit).select("path_rel", "title", F.lit(0.0).alias("rank"))


def place_in_tier() -> Column:
    """Within the path tier pages come by path, elsewhere by rank and title."""
    return F.when(F.col("tier") == 1, F.col("path_rel")).otherwise(F.col("title")).alias("by")


def tiers(corpus: DataFrame, text: str, root: str = "") -> DataFrame:
    """(title, path_rel, tier, rank): all matches, once for each title.

    Tiers come in the order exact, path, full text; the first match of a title stands for it, and
    the path breaks ties.
    """
    query = parse_query(text)
    found = exact_tier(corpus, query).withColumn("tier", F.lit(0)).unionByName(path_tier(corpus, query, root).withColumn("tier", F.lit(1)))
    if query.searchable:
        ranked = bm25(corpus, query).select("path_rel", "title", (-F.round("score", 6)).alias("rank"), F.lit(2).alias("tier"))
        found = found.unionByName(ranked)
    order = F.struct("tier", "rank", place_in_tier(), "path_rel")
    return found.groupBy("title").agg(F.min(order).alias("o")).select("title", F.col("o.path_rel").alias("path_rel"), F.col("o.tier").alias("tier"), F.col("o.rank").alias("rank"))


def snippets(content: Column | str, tokens: tuple[str, ...], most: int = SNIPPETS) -> Column:
    """The first lines with a token, with their neighbours, links stripped and tokens marked: array of (line, text)."""
    parts = F.split(T.col(content), "\n", -1)
    marks = "(?i)(" + "|".join(_literal(t) for t in sorted(tokens, key=lambda t: (-len(t), t))) + ")"

    def hit(x: Column) -> Column:
        low = F.lower(x)
        any_ = F.lit(False)
        for t in tokens:
            any_ = any_ | F.contains(low, F.lit(t))
        return (T.strip(x) != "") & any_ & (F.size(T.terms(x)) > 1)

    numbered = F.filter(F.transform(parts, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: hit(s["x"]))
    context = lambda i: F.array_join(F.filter(F.transform(F.array(F.get(parts, i - 1), F.get(parts, i), F.get(parts, i + 1)), lambda x: T.strip(x)), lambda x: x.isNotNull() & (x != "")), " ")
    return F.transform(F.slice(numbered, 1, most), lambda s: F.struct((s["i"] + 1).alias("line"), F.regexp_replace(T.strip_links(context(s["i"])), F.lit(marks), F.lit("**$1**")).alias("text")))


def _literal(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def line_snippet(content: Column | str, line: Column | str) -> Column:
    """One line with its neighbours, unmarked; null if the line is blank or not there."""
    parts, i = F.split(T.col(content), "\n", -1), T.col(line) - 1
    near = F.filter(F.transform(F.array(F.get(parts, i - 1), F.get(parts, i), F.get(parts, i + 1)), lambda x: T.strip(x)), lambda x: x.isNotNull() & (x != ""))
    return F.when(T.strip(F.get(parts, i)) != "", T.strip_links(F.array_join(near, " ")))


def search(corpus: DataFrame, text: str, limit: int = DEFAULT_LIMIT, offset: int = 0, root: str = "") -> DataFrame:
    """One page of results: position, title, file, summary, snippets, total.

    Ranking and paging go over narrow rows; the page's texts are joined afterwards.
    """
    query = parse_query(text)
    ranked = tiers(corpus, text, root)
    order = Window.orderBy("tier", "rank", F.when(F.col("tier") == 1, F.col("path_rel")).otherwise(F.col("title")), "path_rel")
    total = ranked.agg(F.count("*").alias("total"))
    page = ranked.orderBy("tier", "rank", F.when(F.col("tier") == 1, F.col("path_rel")).otherwise(F.col("title")), "path_rel").limit(max(limit, 0) + offset if limit > 0 else 0)
    page = page.withColumn("position", F.row_number().over(order)).where(F.col("position") > offset)
    page = page.join(F.broadcast(total))  # a single row
    texts = corpus.select("path_rel", "summary", "content")
    # a page is at most `limit` rows, so it is the side that is sent
    out = texts.join(F.broadcast(page), "path_rel")
    return out.select("position", "title", F.col("path_rel").alias("file"), "summary", snippets("content", query.tokens).alias("snippets"), F.col("total") if limit > 0 else F.lit(0).cast("long").alias("total"))


def remaining(total: Column | str, offset: int, shown: Column | str) -> Column:
    """How many further matches there are."""
    return F.greatest(T.col(total) - offset - T.col(shown), F.lit(0))


def suggest(corpus: DataFrame, text: str, limit: int = SUGGEST_LIMIT, least: float = SUGGEST_SCORE) -> DataFrame:
    """Full-text matches, cut to ``limit`` first and to those that hold enough of the tokens then."""
    query = parse_query(text)
    top = bm25(corpus, query).orderBy(F.round("score", 6).desc(), "title", "path_rel").limit(limit)
    out = corpus.select("path_rel", "summary", "content").join(F.broadcast(top), "path_rel")
    return out.where(T.match_fraction(list(query.tokens), "title", "summary", "content") >= least).select("title", F.col("path_rel").alias("file"), "summary", F.round("score", 6).alias("score"))


def quick_pick(corpus: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """What a picker shows while a query is typed: all pages at first, then matches."""
    if not text.strip():
        return corpus.select("title", F.col("path_rel").alias("file"), "summary").orderBy("title", "file")
    return search(corpus, text, limit).orderBy("position").select("title", "file", "summary")
