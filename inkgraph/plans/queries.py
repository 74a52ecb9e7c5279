"""One query for each operator over the driver's tables, with SQL for the same rows where SQL can say it.

Pages, links and revisions are derived from ``documents`` by expressions that
both engines have, so both compute the same input from scratch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frontmatter as fm
from ..functions import markdown as md
from ..functions import text as T
from ..functions.query import parse_query
from ..operators import check, fix, index, lookup, recheck, scaffold, search, snapshots, sync
from ..sources import corpus as C
from ..sources import ignore, mesh, sinks
from ..sources.tables import shared_dir, written
from ..streaming import sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.documents_corpus(_docs(spark, sf_dir))


#: Stored indexes of this process, by application, tables and kind.
_STORED: dict[tuple[str, str, str], index.Index] = {}


def _index(spark: SparkSession, sf_dir: str) -> index.Index:
    """The stored search index of the corpus of ``documents``: made by the first query that needs it, read by the others."""
    key = spark.sparkContext.applicationId, sf_dir, "corpus"
    if key not in _STORED or index.open_index(spark, _STORED[key].path) is None:  # its folder may have been cleared
        _STORED[key] = index.update(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", _corpus(spark, sf_dir))
    return _STORED[key]


def _updated_index(spark: SparkSession, sf_dir: str) -> index.Index:
    """An index after pages came, changed, lost their membership and were deleted, some of it by paths and some by a whole snapshot."""
    key = spark.sparkContext.applicationId, sf_dir, "updated"
    if key not in _STORED or index.open_index(spark, _STORED[key].path) is None:
        path, docs, d = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", _docs(spark, sf_dir), F.col("doc_id")
        revised = docs.withColumn("text", F.when(d % 7 == 1, F.concat(F.lit("revised edition "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
        again = revised.where((d % 19 == 4) & (d % 13 != 5)).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" once more")))
        paths = lambda rows: C.documents_corpus(rows).select("path_rel")
        index.update(spark, path, C.documents_corpus(docs.where(d % 5 != 0)))
        index.update(spark, path, C.documents_corpus(revised.where((d % 10 == 0) | (d % 7 == 1))), deleted=paths(docs.where(d % 11 == 3)))
        index.update(spark, path, C.documents_corpus(revised.where(d % 13 != 5)), whole=True)
        _STORED[key] = index.update(spark, path, C.documents_corpus(again), deleted=paths(docs.where(d % 17 == 2)))
    return _STORED[key]


# Derived inputs in SQL -------------------------------------------------------

CORPUS = """corpus AS (
  SELECT doc_id, 'wiki/' || source || '/' || lang || '/doc-' || doc_id || '.md' AS path_rel,
         split_part(coalesce(text, ''), chr(10), 1) AS title,
         CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1, 120) ELSE '' END AS summary,
         ['d' || doc_id, lang || '-' || (doc_id % 97)] AS aliases, [lang, source] AS tags,
         coalesce(text, '') AS content, sha256(coalesce(text, '')) AS content_hash
  FROM documents)"""

KEYS = """keys AS (
  SELECT path_rel, 0 AS place, title AS raw, 'title' AS kind FROM corpus
  UNION ALL SELECT path_rel, 1, aliases[1], 'alias' FROM corpus
  UNION ALL SELECT path_rel, 2, aliases[2], 'alias' FROM corpus),
own AS (SELECT *, lower(raw) AS key, row_number() OVER (PARTITION BY path_rel, lower(raw) ORDER BY place) AS r FROM keys),
key_rows AS (SELECT path_rel, place, raw, kind, key FROM own WHERE r = 1),
lookup AS (SELECT key, path_rel, raw, kind FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY path_rel, place) AS n FROM key_rows) WHERE n = 1)"""

#: Documents as Markdown: headings every fifth line, and a link on some lines.
PAGES = """md AS (
  SELECT path, doc_id, i + 1 AS line, CASE WHEN i % 5 = 0 THEN repeat('#', level) || ' ' || name
           WHEN i % 7 = 2 THEN x || ' [see ' || i || '](/' || CASE WHEN (doc_id + i) % 13 = 0 THEN 'gone' ELSE 'wiki' END
                || '/doc-' || ((doc_id * 7 + i) % n) || '.md#L' || (i % 5 + 1) || '-L' || (i % 5 + 2) || ')'
           ELSE x END AS text,
         CASE WHEN i % 5 = 0 THEN level END AS level, CASE WHEN i % 5 = 0 THEN name END AS name
  FROM (SELECT *, (i // 5) % 3 + 1 AS level, CASE WHEN (i // 5) % 4 = 3 THEN 'Part 1' ELSE 'Part ' || ((i // 5) % 5) END AS name
        FROM (SELECT 'wiki/doc-' || doc_id || '.md' AS path, doc_id, (SELECT count(*) FROM documents) AS n,
                     unnest(range(0, len(parts))) AS i, unnest(parts) AS x
              FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))))"""

HEADINGS = """base AS (SELECT path, line, level, name AS text, replace(lower(name), ' ', '-') AS base FROM md WHERE level IS NOT NULL),
headings AS (SELECT path, line, level, text, CASE WHEN n = 0 THEN base ELSE base || '-' || n END AS slug
  FROM (SELECT *, row_number() OVER (PARTITION BY path, base ORDER BY line) - 1 AS n FROM base))"""

PAGE_LINKS = r"""links AS (
  SELECT path, line AS source_line, regexp_extract(text, '\]\(([^)]*)\)', 1) AS href,
         regexp_extract(text, '\]\(/([^#]*)#', 1) AS resolved,
         CAST(regexp_extract(text, '#L([0-9]+)-', 1) AS INT) AS start_line, CAST(regexp_extract(text, '-L([0-9]+)\)', 1) AS INT) AS end_line
  FROM md WHERE level IS NULL AND text LIKE '%](/%')"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) as in ``PAGES``."""
    docs = _docs(spark, sf_dir)
    count = docs.agg(F.count("*").alias("n"))

    def line(x, i):
        level = F.repeat(F.lit("#"), (F.floor(i / 5) % 3 + 1).cast("int"))
        name = F.when(F.floor(i / 5) % 4 == 3, F.lit("Part 1")).otherwise(F.concat(F.lit("Part "), (F.floor(i / 5) % 5).cast("string")))
        top = F.when((F.col("doc_id") + i) % 13 == 0, F.lit("gone")).otherwise("wiki")
        link = F.concat(F.lit(" [see "), i.cast("string"), F.lit("](/"), top, F.lit("/doc-"), ((F.col("doc_id") * 7 + i) % F.col("n")).cast("string"), F.lit(".md#L"), (i % 5 + 1).cast("string"), F.lit("-L"), (i % 5 + 2).cast("string"), F.lit(")"))
        return F.when(i % 5 == 0, F.concat(level, F.lit(" "), name)).when(i % 7 == 2, F.concat(x, link)).otherwise(x)

    content = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line), "\n")
    # the count is a single row
    return docs.join(F.broadcast(count)).select(F.concat(F.lit("wiki/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), content.alias("content"))


# Search ----------------------------------------------------------------------

@query(f"WITH {CORPUS}, {KEYS} SELECT key, path_rel, raw, kind FROM lookup")
def s01_exact_lookup(spark, sf_dir):
    return lookup.lookup_keys(_corpus(spark, sf_dir))


@query(f"WITH {CORPUS} SELECT path_rel, title FROM corpus WHERE contains(lower(path_rel || ' /' || path_rel), 'src1') AND contains(lower(path_rel || ' /' || path_rel), 'fr')")
def s02_path_search(spark, sf_dir):
    return index.path_tier(_index(spark, sf_dir), parse_query("SRC1 fr")).select("path_rel", "title")


_SPLIT = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
_FIELDS = [("title", "title", 5), ("aliases", "array_to_string(aliases, ' ')", 4), ("tags", "array_to_string(tags, ' ')", 3), ("keywords", "''", 3), ("summary", "summary", 2), ("body", "content", 1)]


def _bm25_sql(words: list[str]) -> str:
    fields = " UNION ALL ".join(f"SELECT path_rel, title, '{n}' AS field, {w} AS weight, {_SPLIT.format(e)} AS w FROM corpus" for n, e, w in _FIELDS)
    terms = ", ".join(f"('{w}')" for w in words)
    return f"""fields AS ({fields}), terms AS (SELECT * FROM (VALUES {terms}) v(term)),
sizes AS (SELECT field, count(*) AS n, avg(len(w)) AS avgdl FROM fields GROUP BY field),
tf AS (SELECT path_rel, title, field, weight, len(w) AS dl, term, len(list_filter(w, lambda t: t = term)) AS tf FROM fields, terms),
df AS (SELECT field, term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY field, term),
bm AS (SELECT path_rel, title, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM tf JOIN df USING (field, term) JOIN sizes USING (field) WHERE tf > 0 GROUP BY path_rel, title)"""


@query(f"WITH {CORPUS}, {_bm25_sql(['with', 'thin', 'src3'])} SELECT path_rel, title, score FROM bm")
def s03_fts_bm25(spark, sf_dir):
    return index.bm25(_index(spark, sf_dir), parse_query("with thin src3")).withColumn("score", F.round("score", 6))


_TIERS = f"""WITH {CORPUS}, {KEYS}, {_bm25_sql(['en', '5'])},
found AS (
  SELECT path_rel, title, 0 AS tier, CAST(min(kind <> 'title') AS DOUBLE) AS rank FROM key_rows JOIN corpus USING (path_rel) WHERE key = 'en-5' GROUP BY path_rel, title
  UNION ALL SELECT path_rel, title, 1, 0 FROM corpus WHERE contains(lower(path_rel || ' /' || path_rel), 'en') AND contains(lower(path_rel || ' /' || path_rel), '5')
  UNION ALL SELECT path_rel, title, 2, -score FROM bm),
best AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY tier, rank, CASE WHEN tier = 1 THEN path_rel ELSE title END, path_rel) AS n FROM found),
ranked AS (SELECT *, row_number() OVER (ORDER BY tier, rank, CASE WHEN tier = 1 THEN path_rel ELSE title END, path_rel) AS position, count(*) OVER () AS total FROM best WHERE n = 1)"""


@query(f"{_TIERS} SELECT title, path_rel, tier, rank FROM best WHERE n = 1")
def s04_weighted_search(spark, sf_dir):
    return index.tiers(_index(spark, sf_dir), "en-5").drop("doc")


@query(f"{_TIERS} SELECT position, title, path_rel AS file, summary, total FROM ranked JOIN corpus USING (path_rel, title) WHERE position > 5 AND position <= 15")
def s04_search_page(spark, sf_dir):
    return index.search_page(_index(spark, sf_dir), "en-5", limit=10, offset=5).drop("snippets")


@query(f"WITH {CORPUS}, {_bm25_sql(['des', 'und', 'src5'])}, top AS (SELECT * FROM bm ORDER BY score DESC, title, path_rel LIMIT 3) SELECT title, path_rel AS file, summary, score FROM top JOIN corpus USING (path_rel, title) WHERE (CAST(contains(lower(title || chr(10) || summary || chr(10) || content), 'des') AS INT) + CAST(contains(lower(title || chr(10) || summary || chr(10) || content), 'und') AS INT) + CAST(contains(lower(title || chr(10) || summary || chr(10) || content), 'src5') AS INT)) / 3.0 >= 0.5")
def s05_suggest(spark, sf_dir):
    return index.suggest(_index(spark, sf_dir), "des und src5")


#: The documents as they are after the updates of ``_updated_index``.
_UPDATED = CORPUS.replace("FROM documents", "FROM latest_docs")
_LATEST = """latest_docs AS (SELECT * REPLACE (CASE WHEN doc_id % 7 = 1 THEN 'revised edition ' ELSE '' END || coalesce(text, '') || CASE WHEN doc_id % 19 = 4 THEN ' once more' ELSE '' END AS text) FROM documents WHERE doc_id % 13 <> 5 AND doc_id % 17 <> 2)"""
_FIELD_WORDS = " UNION ALL ".join(f"SELECT path_rel, '{n}' AS field, {_SPLIT.format(e)} AS w FROM corpus" for n, e, _ in _FIELDS)


@query(f"""WITH {_LATEST}, {_UPDATED}, f AS ({_FIELD_WORDS}), w AS (SELECT path_rel, field, unnest(w) AS t, unnest(range(0, len(w))) AS i FROM f)
SELECT path_rel, field, count(DISTINCT t) AS terms, count(*) AS words, CAST(sum(i * length(t)) AS BIGINT) AS placed FROM w GROUP BY path_rel, field""")
def i06_index_upsert(spark, sf_dir):
    return index.contents(_updated_index(spark, sf_dir))


@query(f"WITH {_LATEST}, {_UPDATED}, {_bm25_sql(['revised', 'with', 'more'])} SELECT path_rel, title, score FROM bm")
def i07_search_updated(spark, sf_dir):
    return index.bm25(_updated_index(spark, sf_dir), parse_query("revised with more")).withColumn("score", F.round("score", 6))


@query(f"""WITH {_LATEST}, {_UPDATED} SELECT path_rel, title FROM corpus WHERE contains(lower(path_rel), 'doc') AND contains(lower(path_rel), '7') AND contains(lower(path_rel), 'src')""")
def i08_paths_updated(spark, sf_dir):
    return index.path_tier(_updated_index(spark, sf_dir), parse_query("doc 7 src")).select("path_rel", "title")


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(rf"""WITH {CORPUS}, l AS (SELECT path_rel, unnest(range(1, len(p) + 1)) AS line, unnest(p) AS x FROM (SELECT path_rel, string_split(content, chr(10)) AS p FROM corpus)),
near AS (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b FROM l WINDOW w AS (PARTITION BY path_rel ORDER BY line)),
hit AS (SELECT *, row_number() OVER (PARTITION BY path_rel ORDER BY line) AS n FROM near
  WHERE (contains(lower(x), 'with') OR contains(lower(x), 'license')) AND len({_SPLIT.format('x')}) > 1)
SELECT path_rel, line, regexp_replace(regexp_replace(array_to_string(list_filter([{_TRIM.format("coalesce(a, '')")}, {_TRIM.format('x')}, {_TRIM.format("coalesce(b, '')")}], lambda t: t <> ''), ' '), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '(license|with)', '**\1**', 'gi') AS text FROM hit WHERE n <= 3""")
def s06_snippets(spark, sf_dir):
    rows = _corpus(spark, sf_dir).select("path_rel", F.explode(search.snippets("content", ("with", "license"))).alias("s"))
    return rows.select("path_rel", F.col("s.line").cast("long").alias("line"), F.col("s.text").alias("text"))


@query(rf"""WITH {CORPUS}, w AS (SELECT path_rel, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS t FROM (SELECT path_rel, {_SPLIT.format('content')} AS p FROM corpus))
SELECT a.path_rel, count(*) AS n FROM w a JOIN w b ON a.path_rel = b.path_rel AND b.i = a.i + 1 WHERE a.t = 'of' AND b.t = 'the' GROUP BY a.path_rel""")
def s07_phrase_search(spark, sf_dir):
    rows = search.term_rows(_corpus(spark, sf_dir), parse_query('"of the"'), {"body": 1.0})
    return rows.where(F.col("tf")[0] > 0).select("path_rel", F.col("tf")[0].cast("long").alias("n"))


# Lookup ----------------------------------------------------------------------

@query(f"WITH {CORPUS} SELECT title, path_rel, summary, array_to_string(list_sort(aliases), ',') AS aliases, array_to_string(list_sort(tags), ',') AS tags FROM corpus")
def l01_list_pages(spark, sf_dir):
    rows = lookup.list_pages(_corpus(spark, sf_dir))
    return rows.withColumns({c: F.array_join(c, ",") for c in ("aliases", "tags")})


@query(f"WITH {CORPUS} SELECT title, path_rel, summary, array_to_string(list_sort(aliases), ',') AS aliases, array_to_string(list_sort(tags), ',') AS tags FROM corpus WHERE list_contains(tags, 'fr')")
def l02_list_by_tag(spark, sf_dir):
    rows = lookup.list_pages(_corpus(spark, sf_dir), "FR")
    return rows.withColumns({c: F.array_join(c, ",") for c in ("aliases", "tags")})


def _language_links(corpus: DataFrame) -> DataFrame:
    """Each page links to the page of its language, from one of its first lines."""
    return corpus.select(F.col("path_rel").alias("source_file"), (F.col("doc_id") % 4 + 1).cast("int").alias("source_line"), F.concat(F.lit("lang/"), F.col("tags")[0], F.lit(".md")).alias("target_path"))


_BACK = rf"""WITH {CORPUS}, l AS (SELECT path_rel, title, doc_id, unnest(range(1, len(p) + 1)) AS line, unnest(p) AS x FROM (SELECT path_rel, title, doc_id, string_split(content, chr(10)) AS p FROM corpus WHERE tags[1] = 'es')),
near AS (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b FROM l WINDOW w AS (PARTITION BY path_rel ORDER BY line)),
snip AS (SELECT path_rel, title, line, regexp_replace(array_to_string(list_filter([{_TRIM.format("coalesce(a, '')")}, {_TRIM.format('x')}, {_TRIM.format("coalesce(b, '')")}], lambda t: t <> ''), ' '), '\[([^\]]+)\]\([^)]*\)', '\1', 'g') AS text
  FROM near WHERE line = doc_id % 4 + 1 AND {_TRIM.format('x')} <> ''),
once AS (SELECT *, row_number() OVER (PARTITION BY title, text ORDER BY path_rel, line) AS k FROM snip),
top AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY path_rel, line) AS n FROM once WHERE k = 1)"""


@query(f"{_BACK}, known AS (SELECT title, min(path_rel) AS path_rel FROM corpus WHERE tags[1] = 'es' GROUP BY title) SELECT known.title, known.path_rel, coalesce(string_agg(line || ':' || text, '|' ORDER BY n), '') AS snippets FROM known LEFT JOIN (SELECT * FROM top WHERE n <= 3) t USING (title) GROUP BY known.title, known.path_rel")
def l03_backlinks(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    rows = lookup.backlinks(corpus, _language_links(corpus), "lang/es.md")
    return rows.withColumn("snippets", F.array_join(F.transform("snippets", lambda s: F.concat(s["line"].cast("string"), F.lit(":"), s["text"])), "|"))


@query(f"{_BACK} SELECT path_rel AS source_file, title AS source_title, CAST(line AS INT) AS line, text FROM top WHERE n <= 3")
def l04_refs(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    page = spark.range(1).select(F.lit("lang/es.md").alias("path_rel"), F.lit("\0es").alias("title"), F.lit("").alias("content"), F.array().cast("array<string>").alias("aliases"))
    return lookup.refs(corpus.select("path_rel", "title", "content", "aliases").unionByName(page), _language_links(corpus), "lang/es.md")


_INPUTS = """inputs AS (SELECT DISTINCT CASE doc_id % 4 WHEN 0 THEN 'D' || doc_id WHEN 1 THEN path_rel WHEN 2 THEN './x/../' || path_rel ELSE 'nothing-' || doc_id END AS input FROM corpus)"""
_RESOLVED = f"""WITH {CORPUS}, {KEYS}, {_INPUTS}, found AS (
  SELECT input, path_rel, CAST(NULL AS VARCHAR) AS alias FROM inputs JOIN corpus ON replace(input, './x/../', '') = path_rel
  UNION ALL SELECT input, path_rel, CASE WHEN kind = 'alias' THEN raw END FROM inputs JOIN lookup ON lower(input) = key WHERE NOT contains(input, '/'))"""


def _inputs(corpus: DataFrame) -> DataFrame:
    kind, ident = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    return corpus.select(F.when(kind == 0, F.concat(F.lit("D"), ident)).when(kind == 1, F.col("path_rel")).when(kind == 2, F.concat(F.lit("./x/../"), "path_rel")).otherwise(F.concat(F.lit("nothing-"), ident)).alias("input")).distinct()


@query(f"{_RESOLVED} SELECT input, path_rel, title, alias FROM found JOIN corpus USING (path_rel)")
def l05_resolve_page(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    return lookup.resolve_pages(corpus, _inputs(corpus))


@query(f"{_RESOLVED} SELECT inputs.input, title, path_rel, summary, CASE WHEN path_rel IS NULL THEN 1 ELSE 0 END AS code FROM inputs LEFT JOIN (SELECT * FROM found JOIN corpus USING (path_rel)) f USING (input)")
def l06_summaries(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    return lookup.summaries(corpus, _inputs(corpus))


@query(f"{_RESOLVED} SELECT max(CASE WHEN path_rel IS NULL THEN 1 ELSE 0 END) AS code FROM inputs LEFT JOIN found USING (input)")
def l07_exit_code(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    return lookup.exit_code(lookup.summaries(corpus, _inputs(corpus)))


# Markdown --------------------------------------------------------------------

@query(rf"WITH {CORPUS} SELECT path_rel, regexp_replace(translate(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}\- \t]', '', 'g'), ' ' || chr(9), '--'), '^-+|-+$', '', 'g') AS slug, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS kebab FROM corpus")
def m01_slug(spark, sf_dir):
    return _corpus(spark, sf_dir).select("path_rel", T.github_slug("title").alias("slug"), T.kebab("title").alias("kebab"))


@query(f"WITH {PAGES}, {HEADINGS} SELECT path, line, level, text, slug FROM headings")
def m02_headings(spark, sf_dir):
    return md.headings(_pages(spark, sf_dir))


@query(f"""WITH {PAGES}, {HEADINGS}, p AS (SELECT h.path, h.line, h.level AS depth, h.slug, coalesce((SELECT arg_max(a.slug, a.line) FROM headings a WHERE a.path = h.path AND a.line < h.line AND a.level < h.level), '') AS parent_slug FROM headings h)
SELECT path, line, slug, depth, parent_slug, row_number() OVER (PARTITION BY path, depth, parent_slug ORDER BY line) - 1 AS sibling_index FROM p""")
def m03_heading_positions(spark, sf_dir):
    return md.heading_positions(md.headings(_pages(spark, sf_dir))).select("path", "line", "slug", "depth", "parent_slug", "sibling_index")


_SECTIONS = rf"""outl AS (SELECT path, line, text, level, max(CASE WHEN level IS NOT NULL THEN line END) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS head FROM md),
sections AS (SELECT a.path, a.line, a.head AS section_start, greatest(a.head, max(b.line)) AS section_end FROM outl a LEFT JOIN outl b ON a.path = b.path AND b.head = a.head AND b.level IS NULL AND {_TRIM.format('b.text')} <> '' WHERE a.head IS NOT NULL GROUP BY a.path, a.line, a.head)"""


@query(f"WITH {PAGES}, {_SECTIONS} SELECT path, line, section_start, coalesce(section_end, section_start) AS section_end FROM sections")
def m04_sections(spark, sf_dir):
    rows = md.sections(md.outline_lines(_pages(spark, sf_dir)))
    return rows.where(F.size("heading_chain") > 0).select("path", "line", "section_start", "section_end")


@query(f"WITH {PAGES}, {PAGE_LINKS} SELECT path, source_line, href, start_line, end_line FROM links")
def m05_links_extract(spark, sf_dir):
    return md.links(_pages(spark, sf_dir)).select("path", "source_line", "href", "start_line", "end_line")


@query(r"""SELECT DISTINCT f AS fragment, TRY_CAST(nullif(regexp_extract(f, '^[Ll]([0-9]+)', 1), '') AS INT) AS start_line, TRY_CAST(nullif(regexp_extract(f, '^[Ll][0-9]+-[Ll]?([0-9]+)', 1), '') AS INT) AS end_line
FROM (SELECT CASE doc_id % 5 WHEN 0 THEN 'L' || doc_id WHEN 1 THEN 'l' || doc_id || '-L' || (doc_id + 7) WHEN 2 THEN 'L' || doc_id || '-' || (doc_id + 2) || '&sha' WHEN 3 THEN 'heading-' || doc_id ELSE 'L99999999999' END AS f FROM documents)""")
def m06_line_range(spark, sf_dir):
    ident = F.col("doc_id")
    text = lambda x: x.cast("string")
    f = F.when(ident % 5 == 0, F.concat(F.lit("L"), text(ident))).when(ident % 5 == 1, F.concat(F.lit("l"), text(ident), F.lit("-L"), text(ident + 7)))
    f = f.when(ident % 5 == 2, F.concat(F.lit("L"), text(ident), F.lit("-"), text(ident + 2), F.lit("&sha"))).when(ident % 5 == 3, F.concat(F.lit("heading-"), text(ident))).otherwise("L99999999999")
    start, end = md.line_range("fragment")
    return _docs(spark, sf_dir).select(f.alias("fragment")).distinct().select("fragment", start.alias("start_line"), end.alias("end_line"))


@query("SELECT doc_id, CAST(strlen(coalesce(text, '')) + 34 AS BIGINT) AS n_bytes, '`    `' || chr(10) || '   ' || chr(10) || '     ' || chr(10) || '   ' || chr(10) || repeat(' ', 13) || chr(10) AS head FROM documents")
def m07_scrub(spark, sf_dir):
    text = F.concat(F.lit("`code`\n```\nfence\n```\n<!-- note -->\n"), F.coalesce("text", F.lit("")))
    rows = _docs(spark, sf_dir).select("doc_id", md.scrub(text).alias("s"))
    return rows.select("doc_id", (F.octet_length("s").cast("long") - 1).alias("n_bytes"), F.substring("s", 1, 35).alias("head"))


_FRONT = """CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '`title` must be a string.' WHEN 2 THEN '`Check` is a reserved command name. Choose a different title.' WHEN 3 THEN '`tags` must be an array of non-empty strings.' WHEN 4 THEN 'Add a `summary` field — a one-line description of the page.' ELSE NULL END"""


@query(f"SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 5) THEN 'Title ' || doc_id END AS title, CASE WHEN doc_id % 6 = 0 THEN lang || ',' || source WHEN doc_id % 6 = 5 THEN '' END AS tags, {_FRONT} AS message, coalesce(text, '') AS body FROM documents")
def m08_frontmatter(spark, sf_dir):
    ident = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 6
    title = F.when(kind == 1, "title: 42").when(kind == 2, "title: Check").otherwise(F.concat(F.lit('title: "Title '), ident, F.lit('"')))
    tags = F.when(kind == 3, "tags: one").when(kind == 0, F.concat(F.lit("tags: ["), "lang", F.lit(", "), "source", F.lit("]"))).otherwise("keywords: []")
    last = F.when(kind == 4, "other: x").otherwise("summary: A page")
    content = F.concat(F.lit("---\n"), title, F.lit("\n"), tags, F.lit("\n"), last, F.lit("\n---\n"), F.coalesce("text", F.lit("")))
    rows = _docs(spark, sf_dir).select("doc_id", content.alias("content"))
    rows = rows.select("doc_id", fm.parse_frontmatter("content").alias("f"), fm.markdown_body("content").alias("body"))
    return rows.select("doc_id", "f.title", F.array_join("f.tags", ",").alias("tags"), "f.message", "body")


@query(r"""SELECT page_id, i AS ordinal, href FROM (SELECT page_id, unnest(range(0, len(h))) AS i, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<a href="([^"]*)"', 1) AS h FROM pages))""")
def m09_page_hrefs(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('<a href="([^"]*)"'), F.lit(1))).alias("ordinal", "href")).select("page_id", F.col("ordinal").cast("long").alias("ordinal"), "href")


# Check -----------------------------------------------------------------------

@query(f"WITH {CORPUS}, {KEYS}, f AS (SELECT key, min(path_rel) AS first FROM key_rows GROUP BY key) SELECT 'collision' AS kind, path_rel AS file, 1 AS line, '`' || raw || '` is already used by `' || first || '`.' AS message FROM key_rows JOIN f USING (key) WHERE path_rel > first")
def c01_collisions(spark, sf_dir):
    return check.collisions(_corpus(spark, sf_dir))


_BROKEN = "SELECT 'broken_link' AS kind, path AS file, CAST(source_line AS INT) AS line, 'File `/' || resolved || '` not found.' AS message FROM links WHERE resolved NOT IN (SELECT path FROM md)"
_RANGES = """SELECT 'broken_anchor' AS kind, l.path AS file, CAST(source_line AS INT) AS line, 'Line range `L' || start_line || '–L' || end_line || '` exceeds `/' || resolved || '` (' || n || ' lines).' AS message
FROM links l JOIN size s ON resolved = s.path WHERE start_line > n OR end_line > n"""
_SIZE = """size AS (SELECT path, count(*) - max(CASE WHEN last THEN 1 ELSE 0 END) AS n FROM (SELECT path, text = '' AND line = max(line) OVER (PARTITION BY path) AS last FROM md) GROUP BY path)"""


@query(f"WITH {PAGES}, {PAGE_LINKS} {_BROKEN}")
def c02_broken_links(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return check.broken_links(md.links(pages), pages.select("path"))


@query(f"""WITH {PAGES}, {HEADINGS}, n AS (SELECT count(*) AS n FROM documents), l AS (SELECT 'wiki/doc-' || doc_id || '.md' AS path, doc_id % 9 + 1 AS line, 'wiki/doc-' || ((doc_id * 7 + 3) % n) || '.md' AS resolved, 'part-' || (doc_id % 5) AS fragment FROM documents, n WHERE doc_id % 3 = 0 AND doc_id % 11 <> 0)
SELECT 'broken_anchor' AS kind, path AS file, CAST(line AS INT) AS line, 'Heading `#' || fragment || '` not found in `/' || resolved || '`.' AS message FROM l WHERE NOT EXISTS (SELECT 1 FROM headings h WHERE h.path = l.resolved AND h.slug = l.fragment) AND resolved IN (SELECT path FROM md)""")
def c03_broken_headings(spark, sf_dir):
    return check.broken_headings(C.documents_links(_docs(spark, sf_dir)), _pages(spark, sf_dir))


@query(f"WITH {PAGES}, {PAGE_LINKS}, {_SIZE} {_RANGES}")
def c04_line_bounds(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return check.broken_ranges(md.links(pages), pages)


def _links(pages: DataFrame) -> DataFrame:
    """The links of pages, written: a query reads them more than once."""
    return written(md.links(pages), "links")


def _anchors(links: DataFrame) -> DataFrame:
    """A mesh for every second page: its links to ranges that start on an odd line, and the page itself."""
    links = check.checked_links(links).where(F.regexp_extract("path", r"doc-(\d+)", 1).cast("long") % 2 == 0)
    mesh = F.concat(F.lit("mesh/"), F.col("path"))
    own = links.select(mesh.alias("mesh"), "path", F.lit(0).alias("start_line"), F.lit(0).alias("end_line"))
    to = links.where("start_line % 2 = 1").select(mesh.alias("mesh"), F.col("resolved").alias("path"), "start_line", "end_line")
    return written(own.union(to).distinct(), "anchors")


_MESH = """doc AS (SELECT *, CAST(regexp_extract(path, 'doc-([0-9]+)', 1) AS BIGINT) AS d FROM links),
open AS (SELECT * FROM doc x WHERE resolved IN (SELECT path FROM md) AND NOT (d % 2 = 0 AND (start_line % 2 = 1 OR resolved = path))
  AND NOT EXISTS (SELECT 1 FROM doc y WHERE y.d % 2 = 0 AND y.path = x.resolved AND y.resolved = x.path AND y.start_line % 2 = 1))"""
_UNCOVERED = "SELECT 'mesh_uncovered' AS kind, path AS file, CAST(source_line AS INT) AS line, 'Link to `' || resolved || '#L' || start_line || '-L' || end_line || '` is not covered by a mesh.' AS message FROM open"


@query(f"WITH {PAGES}, {PAGE_LINKS}, {_MESH} {_UNCOVERED}")
def c05_mesh_uncovered(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    links = _links(pages)
    return check.uncovered(links, _anchors(links), pages.select("path"))


@query(f"""WITH {PAGES}, {PAGE_LINKS}, {_SIZE}, {_MESH}, every AS ({_BROKEN} UNION ALL {_RANGES} UNION ALL {_UNCOVERED}
UNION ALL SELECT 'frontmatter', path, 1, 'Add frontmatter with `title` and `summary`.' FROM md WHERE line = 1) SELECT kind, file, line, message FROM every""")
def c06_all_diagnostics(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    none = C.corpus_of(pages.limit(0))
    links = _links(pages)
    return check.check(pages, none, pages.select("path"), _anchors(links), links=links)


# Incremental -----------------------------------------------------------------

def _inventories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("t"))
    ident = F.col("doc_id")
    old = docs.where(ident % 10 != 0).select("path", F.lit(1).cast("long").alias("mtime_ns"), F.octet_length("t").cast("long").alias("size_bytes"), F.sha2("t", 256).alias("content_hash"))
    t = F.when(ident % 7 == 0, F.concat("t", F.lit("!"))).otherwise(F.col("t"))
    new = docs.where(ident % 10 != 1).select("path", F.when((ident % 7 == 0) | (ident % 4 == 0), 2).otherwise(1).cast("long").alias("mtime_ns"), F.octet_length(t).cast("long").alias("size_bytes"), F.sha2(t, 256).alias("content_hash"))
    return old, new


_STATUS = "CASE WHEN doc_id % 10 = 0 THEN 'added' WHEN doc_id % 10 = 1 THEN 'deleted' WHEN doc_id % 7 = 0 THEN 'changed'"


@query(f"SELECT 'doc-' || doc_id AS path, {_STATUS} WHEN doc_id % 4 = 0 THEN 'touched' ELSE 'unchanged' END AS status FROM documents")
def i01_change_set(spark, sf_dir):
    return sync.change_set(*_inventories(spark, sf_dir))


@query(f"SELECT * FROM (SELECT 'doc-' || doc_id AS path, {_STATUS} END AS status FROM documents) WHERE status IS NOT NULL")
def i02_hash_skip(spark, sf_dir):
    return sync.hash_changes(*_inventories(spark, sf_dir))


@query("""SELECT 'doc-' || doc_id || CASE WHEN doc_id % 10 = 0 THEN '-new' ELSE '' END AS path FROM documents WHERE doc_id % 10 <> 1""")
def i03_apply_changes(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"))
    gone = docs.where(F.col("doc_id") % 10 <= 1).select("path")
    came = docs.where(F.col("doc_id") % 10 == 0).select(F.concat("path", F.lit("-new")).alias("path"))
    return sync.apply_changes(docs.select("path"), came, gone)


@query(f"WITH {CORPUS}, t AS (SELECT content_hash, min(path_rel) AS first, count(*) AS n FROM corpus GROUP BY content_hash) SELECT path_rel AS old, 'moved/' || path_rel AS new FROM corpus JOIN t USING (content_hash) WHERE n = 1 AND doc_id % 3 = 0")
def i04_renames(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    moved = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("moved/"), "path_rel")).otherwise(F.col("path_rel"))
    return sync.renamed(corpus.select(F.col("path_rel").alias("path"), "content_hash"), corpus.select(moved.alias("path"), "content_hash"))


@query("SELECT event_type AS event, count(*) AS n, round(sum(value), 3) AS total_ms, round(avg(value), 3) AS mean_ms, round(max(value), 3) AS max_ms FROM events GROUP BY event_type")
def p01_event_stats(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return sync.event_stats(events.select(F.col("event_type").alias("event"), F.col("value").alias("duration_ms")))


@query(f"WITH {PAGES}, {PAGE_LINKS}, f AS (SELECT DISTINCT path FROM md) SELECT path FROM f WHERE path NOT IN (SELECT resolved FROM links) AND NOT regexp_matches(path, 'doc-[0-9]*7\\.md$')")
def p02_uncovered_files(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return sync.uncovered_files(pages, C.links_of(md.links(pages)), r"doc-[0-9]*7\.md$")


# Repair ----------------------------------------------------------------------

def _renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    path = lambda i: F.concat(F.lit("gone/doc-"), i.cast("string"), F.lit(".md"))
    ident = F.col("doc_id")
    return docs.where(ident % 8 != 0).select(path(ident).alias("old"), F.when(ident % 2 == 0, F.concat(F.lit("wiki/doc-"), ident.cast("string"), F.lit(".md"))).when(ident % 5 == 0, path(ident * 8)).otherwise(path(ident * 2)).alias("new"))


_RENAMES = """ren AS (SELECT 'gone/doc-' || doc_id || '.md' AS old, CASE WHEN doc_id % 2 = 0 THEN 'wiki/doc-' || doc_id || '.md' WHEN doc_id % 5 = 0 THEN 'gone/doc-' || (doc_id * 8) || '.md' ELSE 'gone/doc-' || (doc_id * 2) || '.md' END AS new FROM documents WHERE doc_id % 8 <> 0),
closure AS (SELECT old, new FROM ren UNION SELECT c.old, r.new FROM closure c JOIN ren r ON c.new = r.old)"""


@query(f"WITH RECURSIVE {_RENAMES} SELECT old, new FROM closure")
def x01_rename_closure(spark, sf_dir):
    return fix.rename_closure(_renames(spark, sf_dir))


_FIX = f"""WITH RECURSIVE {_RENAMES}, {PAGES}, {PAGE_LINKS}, succ AS (SELECT old, list_sort(list(new)) AS c FROM closure GROUP BY old),
plan AS (SELECT path, source_line, href, c, CASE WHEN c IS NULL THEN 'target deleted; no successor' WHEN len(c) > 1 THEN 'ambiguous rename: ' || array_to_string(c, ', ')
  WHEN c[1] NOT IN (SELECT path FROM md) THEN 'target deleted; no successor (rename destination ' || c[1] || ' missing)' END AS why
  FROM links LEFT JOIN succ ON resolved = old WHERE resolved NOT IN (SELECT path FROM md))"""


@query(f"{_FIX} SELECT path AS file, CAST(source_line AS INT) AS line, 'broken_link_rename' AS kind, href AS old_href, '/' || c[1] || '#' || split_part(href, '#', 2) AS new_href, 'renamed to ' || c[1] AS reason, 'high' AS confidence FROM plan WHERE why IS NULL")
def x02_fix_plan(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return fix.plan_renames(md.links(pages), pages.select("path"), _renames(spark, sf_dir))[0].drop("byte_start", "byte_end")


@query(f"{_FIX} SELECT path AS file, CAST(source_line AS INT) AS line, 'broken_link_rename' AS kind, why AS reason FROM plan WHERE why IS NOT NULL")
def x02_fix_skipped(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return fix.plan_renames(md.links(pages), pages.select("path"), _renames(spark, sf_dir))[1]


@query(f"{_FIX} SELECT path, CAST(sum(strlen('/' || c[1] || '#' || split_part(href, '#', 2)) - strlen(href)) AS BIGINT) AS grown FROM plan WHERE why IS NULL GROUP BY path")
def x06_patched_pages(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    fixes = written(fix.plan_renames(md.links(pages), pages.select("path"), _renames(spark, sf_dir))[0], "fixes")
    patched = fix.apply_fixes(pages, fixes).select("path", F.octet_length("content").alias("now"))
    grown = patched.join(pages.select("path", F.octet_length("content").alias("old")), "path").select("path", (F.col("now") - F.col("old")).cast("long").alias("grown"))
    return grown.join(fixes.select(F.col("file").alias("path")).distinct(), "path", "left_semi")


@query(f"""WITH {PAGES}, {PAGE_LINKS}, {_MESH}, moved AS (SELECT DISTINCT path AS mesh, resolved, start_line, end_line FROM doc WHERE d % 2 = 0 AND d % 6 <> 0 AND start_line % 2 = 1),
covers AS (SELECT mesh, mesh AS path FROM moved UNION SELECT mesh, resolved FROM moved)
SELECT DISTINCT path AS file, CAST(source_line AS INT) AS line, 'mesh_anchor_shift' AS kind, href AS old_href,
'/' || resolved || '#L' || (start_line + 10) || '-L' || (end_line + 10) AS new_href, 'high' AS confidence FROM doc JOIN moved USING (resolved, start_line, end_line) JOIN covers USING (mesh, path)""")
def x04_mesh_shift(spark, sf_dir):
    """All ranges moved by ten lines; every third mesh has a changed anchor too, so its findings are left alone."""
    pages = _pages(spark, sf_dir)
    links = _links(pages)
    anchors = _anchors(links)
    drift = anchors.where("start_line > 0").select(F.lit("MOVED").alias("code"), "mesh", "path", "start_line", "end_line", F.col("path").alias("new_path"), (F.col("start_line") + 10).alias("new_start"), (F.col("end_line") + 10).alias("new_end"))
    changed = drift.where(F.regexp_extract("mesh", r"doc-(\d+)", 1).cast("long") % 6 == 0).withColumn("code", F.lit("CHANGED"))
    fixes = fix.plan_shifts(links, anchors, drift.union(changed))[0]
    return fixes.select("file", "line", "kind", "old_href", "new_href", "confidence")


# Scaffold --------------------------------------------------------------------

_DRAFTS = f"""{PAGES}, {PAGE_LINKS}, {_SECTIONS},
each AS (SELECT l.path AS page, section_start, coalesce(section_end, section_start) AS section_end, resolved || '#L' || start_line || '-L' || end_line AS anchor, min(source_line) AS pos, resolved FROM links l JOIN sections s ON s.path = l.path AND s.line = l.source_line GROUP BY ALL),
drafts AS (SELECT page, page || '#L' || section_start || '-L' || section_end || ',' || string_agg(anchor, ',' ORDER BY pos) AS anchors, 'part-' || split_part(name, ' ', 2) AS noun, min(section_start) AS section_start, list(resolved ORDER BY pos) AS targets
  FROM each JOIN md ON md.path = page AND md.line = section_start GROUP BY page, section_start, section_end, name)"""


def _joined(rows: DataFrame) -> DataFrame:
    return rows.withColumn("anchors", F.array_join(F.transform("anchors", lambda a: F.concat(a["path"], F.lit("#L"), a["start_line"].cast("string"), F.lit("-L"), a["end_line"].cast("string"))), ","))


@query(f"WITH {_DRAFTS} SELECT page, anchors, noun FROM drafts")
def g01_sections_group(spark, sf_dir):
    return _joined(scaffold.drafts(scaffold.range_links(_pages(spark, sf_dir)))).select("page", "anchors", "noun")


@query(f"WITH {_DRAFTS} SELECT page, anchors, noun, CAST(1 AS BIGINT) AS merged FROM drafts")
def g02_consolidate(spark, sf_dir):
    return _joined(scaffold.consolidate(scaffold.drafts(scaffold.range_links(_pages(spark, sf_dir))))).select("page", "anchors", "noun", "merged")


def _section_anchors(rows: DataFrame) -> DataFrame:
    """A mesh for the sections that start on an odd line, with their first target."""
    odd = rows.where(F.col("anchors")[0]["start_line"] % 2 == 1).select(F.concat(F.lit("mesh/"), "page", F.lit("/"), F.col("anchors")[0]["start_line"].cast("string")).alias("mesh"), F.explode(F.slice("anchors", 1, 2)).alias("a"))
    return odd.select("mesh", "a.*")


@query(f"WITH {_DRAFTS} SELECT page, CASE WHEN section_start % 2 = 1 THEN 'mesh/' || page || '/' || section_start END AS extends, CASE WHEN section_start % 2 = 1 THEN array_to_string(string_split(anchors, ',')[3:], ',') ELSE anchors END AS anchors FROM drafts WHERE section_start % 2 = 0 OR len(string_split(anchors, ',')) > 2")
def g03_extension(spark, sf_dir):
    rows = scaffold.consolidate(scaffold.drafts(scaffold.range_links(_pages(spark, sf_dir))))
    return _joined(scaffold.extend(rows, _section_anchors(rows))).select("page", "extends", "anchors")


@query(f"WITH {_DRAFTS} SELECT page, anchors, noun FROM drafts WHERE len(list_filter(targets, lambda t: starts_with(t, 'gone/'))) = 0")
def g04_drop_missing(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    rows = scaffold.consolidate(scaffold.drafts(scaffold.range_links(pages))).withColumn("slug", F.lit("x"))
    return _joined(scaffold.drop_missing(rows, pages.select("path"))[0]).select("page", "anchors", "noun")


@query(f"WITH {_DRAFTS} SELECT count(*) AS n, count(*) AS n_slugs, CAST(1 AS BIGINT) AS same_base FROM drafts")
def g05_slug_resolution(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    rows = written(scaffold.consolidate(scaffold.drafts(scaffold.range_links(pages))), "drafts")
    rows = rows.withColumns({"title": F.lit("A title"), "extends": F.lit(None).cast("string")})
    held = spark.range(1).select(F.lit("wiki/part-1").alias("mesh"))
    named = scaffold.name_drafts(rows, held)
    base = F.col("slug").rlike("^wiki/(?:.*/)?part-[0-9]+(?:-[0-9]+)?$")
    return named.agg(F.count("*").alias("n"), F.countDistinct("slug").alias("n_slugs"), F.min(base.cast("long")).alias("same_base"))


# Streams and whole runs -----------------------------------------

@query("""SELECT 'doc-' || doc_id AS path, CAST(CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS mtime_ns, sha256(coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN '!' ELSE '' END) AS content_hash FROM documents WHERE doc_id % 10 <> 0""")
def i05_stream_sync(spark, sf_dir):
    """The pages arrive as two files of versions; a stream merges them into the newest of each path."""
    import uuid

    from ..streaming import sync as stream

    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    docs = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    first = docs.select("path", "content", F.lit(1).cast("long").alias("mtime_ns"), F.lit(False).alias("deleted"))
    later = docs.where(F.col("doc_id") % 5 == 0).select("path", F.concat("content", F.lit("!")).alias("content"), F.lit(2).cast("long").alias("mtime_ns"), (F.col("doc_id") % 10 == 0).alias("deleted"))
    for versions in (first, later):
        versions.write.mode("append").json(f"{root}/in")
        stream.start(spark, f"{root}/in", f"{root}/pages", f"{root}/state").awaitTermination()
    return stream.current(spark, f"{root}/pages").where("not deleted").select("path", "mtime_ns", "content_hash")


@query()
def g06_scaffold_json(spark, sf_dir):
    """The whole proposal for pages that have no mesh yet, as ordered JSON arrays, read back: part, position and value of each element."""
    folder = f"{shared_dir(spark)}/scaffold-{uuid.uuid4().hex}"
    pages = written(_pages(spark, sf_dir), "scaffold-pages")
    none = spark.createDataFrame([], "mesh string, path string, start_line int, end_line int")
    scaffold.write_json(folder, *scaffold.scaffold(pages, none, pages.select("path")))
    parts = {"pages": "path string, title string, meshes array<struct<slug: string, headingChain: array<string>, anchors: array<struct<path: string, startLine: int, endLine: int>>>>", "droppedMeshes": "slug string, missingPath string, page string", "parseErrors": "path string, category string, message string"}
    out = [sinks.read_array(spark, f"{folder}/{name}", schema).select(F.lit(name).alias("part"), "position", F.to_json("row").alias("value")) for name, schema in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


# Editor operators -----------------------------------------------------------

def _target(docs: DataFrame, step: int) -> DataFrame:
    """Documents with ``j``, the number of another document."""
    count = docs.agg(F.count("*").alias("n"))
    return docs.join(F.broadcast(count)).withColumn("j", (F.col("doc_id") * 7 + step) % F.col("n"))  # the count is a single row


@query(f"""WITH {CORPUS}, every AS (SELECT path_rel AS path, title, substr(path_rel, 6) AS tail FROM corpus UNION ALL SELECT 'notes/x-' || doc_id || '.md', NULL, NULL FROM documents WHERE doc_id % 3 = 0),
seen AS (SELECT CASE WHEN tail IS NULL THEN '../' || path ELSE './' || tail END AS href, path, title FROM every)
SELECT href, coalesce(title, path) AS label, CASE WHEN title IS NOT NULL THEN '0_' || title ELSE '1_' || href END AS sort_key FROM seen""")
def e01_completions(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    notes = _docs(spark, sf_dir).where(F.col("doc_id") % 3 == 0).select(F.concat(F.lit("notes/x-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    pictures = notes.select(F.concat("path", F.lit(".png")).alias("path"))
    return lookup.completions(corpus, corpus.select(F.col("path_rel").alias("path")).union(notes).union(pictures), "wiki/index.md")


@query(f"""WITH {CORPUS}, n AS (SELECT count(*) AS n FROM documents), l AS (SELECT path_rel AS path, (doc_id * 7 + 3) % n AS j FROM corpus, n)
SELECT l.path, t.path_rel AS target_path, t.title AS target_title, t.summary AS target_summary FROM l JOIN corpus t ON t.doc_id = j""")
def e02_hover(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    to = corpus.select(F.col("doc_id").alias("j"), F.col("path_rel").alias("target_path"))
    links = _target(corpus, 3).select(F.col("path_rel").alias("path"), "j").join(to, "j").drop("j")
    return lookup.hover(corpus, links)


@query(f"""WITH {PAGES}, {PAGE_LINKS}, moves AS (SELECT 'wiki/doc-' || doc_id || '.md' AS old, CASE WHEN doc_id % 2 = 0 THEN 'moved/doc-' || doc_id || '.md' ELSE 'doc-' || doc_id || '.md' END AS new FROM documents WHERE doc_id % 3 = 0)
SELECT path, href AS old_href, '/' || new || '#' || split_part(href, '#', 2) AS new_href FROM links JOIN moves ON resolved = old""")
def e04_moved_hrefs(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    ident = F.col("doc_id").cast("string")
    moves = _docs(spark, sf_dir).where(F.col("doc_id") % 3 == 0).select(F.concat(F.lit("wiki/doc-"), ident, F.lit(".md")).alias("old"), F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("moved/doc-")).otherwise("doc-"), ident, F.lit(".md")).alias("new"))
    links = check.checked_links(md.links(pages)).withColumnRenamed("resolved", "target_path")
    return lookup.moved_hrefs(links, moves).select("path", "old_href", "new_href")


@query(f"{_TIERS} SELECT title, path_rel AS file, summary FROM ranked JOIN corpus USING (path_rel, title) WHERE position <= 20")
def e05_quick_pick(spark, sf_dir):
    return search.quick_pick(_corpus(spark, sf_dir), "en-5")


@query(f"WITH {CORPUS} SELECT title, path_rel AS file, summary FROM corpus")
def e05_quick_pick_all(spark, sf_dir):
    return search.quick_pick(_corpus(spark, sf_dir), " ")


@query(f"{_TIERS} SELECT position, greatest(total - 5 - 10, 0) AS more FROM ranked WHERE position > 5 AND position <= 15")
def s08_other_matches(spark, sf_dir):
    return search.search(_corpus(spark, sf_dir), "en-5", limit=10, offset=5).select("position", search.remaining("total", 5, F.lit(10)).alias("more"))


@query(f"WITH {CORPUS} SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN NULL ELSE path_rel END AS tail FROM corpus")
def j19_suffix_paths(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    kind = F.col("doc_id") % 3
    rows = corpus.select("doc_id", F.when(kind == 0, F.concat(F.lit("a/b/"), "path_rel")).when(kind == 1, F.col("path_rel")).otherwise(F.concat(F.lit("none/"), F.col("doc_id").cast("string"))).alias("path"))
    return lookup.suffix_path("path", corpus.select(F.col("path_rel").alias("path")), rows, "tail").select("doc_id", "tail")


# All messages and all kinds of hrefs -----------------------------------------

def _made_links(rows: DataFrame, target, start=None, end=None, fragment=None) -> DataFrame:
    """Links as ``markdown.links`` gives them, on line 3 of each document's page."""
    none = F.lit(None).cast("int")
    return rows.select(
        F.concat(F.lit("wiki/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit(0).alias("ordinal"), F.lit("internal").alias("kind"), target.alias("target"),
        (F.lit(None).cast("string") if fragment is None else fragment).alias("fragment"), (none if start is None else start.cast("int")).alias("start_line"), (none if end is None else end.cast("int")).alias("end_line"),
        F.lit("x").alias("text"), target.alias("href"), F.lit(3).alias("source_line"), F.lit(0).alias("byte_start"), F.lit(1).alias("byte_end"),
    )


_KINDS_OF_HREF = "CASE doc_id % 3 WHEN 0 THEN '/wiki/doc-' || j || '.md' WHEN 1 THEN './doc-' || j || '.md' ELSE 'doc-' || j || '.md' END"


@query(f"""WITH {PAGES}, {_SIZE}, c AS (SELECT count(*) AS c FROM documents), l AS (SELECT *, {_KINDS_OF_HREF} AS target FROM (SELECT doc_id, (doc_id * 7 + 3) % c AS j, doc_id % 6 AS a, (doc_id * 5) % 9 AS b FROM documents, c)),
m AS (SELECT doc_id, CASE WHEN a = 0 THEN 'Line numbers are 1-based. Replace `L0` with `L1` in `' || target || '`.' WHEN a > n OR b > n THEN 'Line range `L' || a || '–L' || b || '` exceeds `' || target || '` (' || n || ' lines).'
  WHEN a > b THEN 'Line range start (`L' || a || '`) must not exceed end (`L' || b || '`) in `' || target || '`.' END AS message FROM l JOIN size s ON s.path = 'wiki/doc-' || j || '.md')
SELECT 'broken_anchor' AS kind, 'wiki/doc-' || doc_id || '.md' AS file, 3 AS line, message FROM m WHERE message IS NOT NULL""")
def c07_range_messages(spark, sf_dir):
    rows = _target(_docs(spark, sf_dir), 3)
    name = F.concat(F.lit("doc-"), F.col("j").cast("string"), F.lit(".md"))
    target = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/wiki/"), name)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("./"), name)).otherwise(name)
    return check.broken_ranges(_made_links(rows, target, F.col("doc_id") % 6, F.col("doc_id") * 5 % 9), _pages(spark, sf_dir))


@query("""WITH c AS (SELECT count(*) AS c FROM documents), l AS (SELECT doc_id, (doc_id * 7 + 3) % c AS j FROM documents, c)
SELECT 'broken_link' AS kind, 'wiki/doc-' || doc_id || '.md' AS file, 3 AS line, CASE doc_id % 5 WHEN 0 THEN 'File `/gone/x.md` not found.' WHEN 1 THEN 'File `./gone.md` not found.' WHEN 2 THEN 'File `wiki/doc-' || j || '.md` not found at page-relative path.' || chr(10) || 'If you meant a repo-relative path, use `/wiki/doc-' || j || '.md` instead.'
  ELSE 'File `none/' || j || '.md` not found.' END AS message FROM l WHERE doc_id % 5 <> 4""")
def c08_kinds_of_href(spark, sf_dir):
    rows = _target(_docs(spark, sf_dir), 3)
    kind, j = F.col("doc_id") % 5, F.col("j").cast("string")
    target = F.when(kind == 0, F.lit("/gone/x.md")).when(kind == 1, F.lit("./gone.md")).when(kind == 2, F.concat(F.lit("wiki/doc-"), j, F.lit(".md"))).when(kind == 3, F.concat(F.lit("none/"), j, F.lit(".md"))).otherwise(F.concat(F.lit("../wiki/doc-"), j, F.lit(".md")))
    return check.broken_links(_made_links(rows, target), _pages(spark, sf_dir).select("path"))


@query("""SELECT CASE WHEN doc_id % 5 = 0 THEN 'runtime' ELSE 'frontmatter' END AS kind, 'p/' || doc_id || '.md' AS file, 1 AS line, CASE WHEN doc_id % 5 = 0 THEN 'Cannot read `p/' || doc_id || '.md`.' ELSE 'Add frontmatter with `title` and `summary`.' END AS message
FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'mesh_unavailable', '', 0, 'Coverage data is not available.'""")
def c09_scope_and_unreadable(spark, sf_dir):
    path = F.concat(F.lit("p/"), F.col("doc_id").cast("string"), F.lit(".md"))
    rows = _docs(spark, sf_dir).select("doc_id", path.alias("path"), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("Plain "), F.col("doc_id").cast("string"))).alias("content"))
    pages = rows.select("path", "content")
    return check.check(pages, C.corpus_of(pages), pages.select("path"), scope=rows.where(F.col("doc_id") % 2 == 0).select("path"))


@query(f"WITH {PAGES}, {PAGE_LINKS}, f AS ({_BROKEN}) SELECT 'Error: Broken Link' || chr(10) || file || ':' || line || chr(10) || message AS value FROM f")
def k04_text_results(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return sync.diagnostics_text(check.broken_links(md.links(pages), pages.select("path")))


# Repairs of anchors ----------------------------------------------------------

def _linked(rows: DataFrame, head, fragment: str) -> DataFrame:
    """(path, content): a page for each document that links to an anchor of the page of ``j``."""
    j = F.col("j").cast("string")
    link = F.concat(F.lit("[x](/wiki/a-"), j, F.lit(f".md#{fragment}-"), j, F.lit(")"))
    return rows.select(F.concat(F.lit("wiki/a-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat(head, F.lit("\n\n"), link, F.lit("\n")).alias("content"))


@query("""WITH c AS (SELECT count(*) AS c FROM documents), l AS (SELECT doc_id, (doc_id * 7 + 3) % c AS j FROM documents, c),
t AS (SELECT *, CASE j % 4 WHEN 0 THEN 'title-' || j WHEN 1 THEN 'first-' || j WHEN 2 THEN 'only-' || j END AS slug, CASE j % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'first H1' WHEN 2 THEN 'first heading' END AS label FROM l)
SELECT 'wiki/a-' || doc_id || '.md' AS file, 'alias_to_canonical' AS kind, '/wiki/a-' || j || '.md#' || slug AS new_href,
  CASE WHEN slug IS NULL THEN 'alias `old-name-' || j || '` listed but target has no headings (tried title slug `title-' || j || '`, first H1, first heading)'
  ELSE 'anchor `old-name-' || j || '` is an alias for title `Title ' || j || '`; rewriting to canonical slug `' || slug || '` (' || label || ')' END AS reason FROM t""")
def x05_alias_fix(spark, sf_dir):
    ident = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 4
    body = F.when(kind == 0, F.concat(F.lit("## Some\n# Title "), ident)).when(kind == 1, F.concat(F.lit("## Some\n# First "), ident)).when(kind == 2, F.concat(F.lit("### Only "), ident)).otherwise(F.lit("Text"))
    head = F.concat(F.lit("---\ntitle: Title "), ident, F.lit("\nsummary: A page\naliases: [Old Name "), ident, F.lit(", Other]\n---\n"), body)
    pages = _linked(_target(_docs(spark, sf_dir), 3), head, "old-name")
    fixes, skips = fix.plan_aliases(md.links(pages), pages)
    none = skips.withColumn("new_href", F.lit(None).cast("string"))
    return fixes.select("file", "kind", "new_href", "reason").union(none.select("file", "kind", "new_href", "reason"))


@query("""WITH c AS (SELECT count(*) AS c FROM documents), l AS (SELECT doc_id, (doc_id * 7 + 3) % c AS j FROM documents, c)
SELECT 'wiki/a-' || doc_id || '.md' AS file, 'heading_rename' AS kind, CASE WHEN j % 3 = 0 THEN '/wiki/a-' || j || '.md#new-' || j END AS new_href,
  CASE j % 3 WHEN 0 THEN 'heading renamed to `#new-' || j || '`' WHEN 1 THEN 'heading `#old-' || j || '` deleted' ELSE 'heading `#old-' || j || '` not found in any revision' END AS reason FROM l""")
def x03_heading_rename(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    ident, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    head = F.concat(F.lit("# Top\n\n## Kept\n"), F.when(kind == 0, F.concat(F.lit("\n## New "), ident)).otherwise(F.lit("")))
    pages = _linked(_target(docs, 3), head, "old")
    path = F.concat(F.lit("wiki/a-"), ident, F.lit(".md"))
    old = F.concat(F.lit("# Top\n\n## Kept\n\n## "), F.when(kind == 2, F.lit("Another ")).otherwise("Old "), ident, F.lit("\n"))
    newest = docs.select(path.alias("path"), F.lit(0).alias("ord"), F.lit("# Top\n").alias("content"))
    revisions = newest.union(docs.select(path, F.lit(1), old)).union(docs.select(path, F.lit(2), F.lit("# Old\n")))
    fixes, skips = fix.plan_headings(md.links(pages), pages, revisions)
    none = skips.withColumn("new_href", F.lit(None).cast("string"))
    return fixes.select("file", "kind", "new_href", "reason").union(none.select("file", "kind", "new_href", "reason"))


@query(f"{_FIX} SELECT 'broken_link' AS kind, path AS file, CAST(source_line AS INT) AS line, 'File `/' || split_part(substr(href, 2), '#', 1) || '` not found.' AS message FROM plan WHERE why IS NOT NULL")
def x08_recheck(spark, sf_dir):
    """What a check finds once all repairs are made."""
    pages = _pages(spark, sf_dir)
    none = spark.createDataFrame([], "path string, ord int, content string")
    patched = fix.fix(pages, pages.select("path"), _renames(spark, sf_dir), none)[2]
    return check.broken_links(md.links(patched), patched.select("path"))


# Proposals with merges and names ---------------------------------------------

@query(f"WITH {_DRAFTS} SELECT page, anchors, noun, CAST(CASE WHEN section_start % 2 = 1 THEN 2 ELSE 1 END AS BIGINT) AS merged FROM drafts")
def g07_merged_drafts(spark, sf_dir):
    rows = scaffold.drafts(scaffold.range_links(_pages(spark, sf_dir)))
    again = rows.where(F.col("anchors")[0]["start_line"] % 2 == 1).withColumns({"ord": F.col("ord") + 1_000_000, "noun": F.lit("later")})
    return _joined(scaffold.consolidate(rows.unionByName(again))).select("page", "anchors", "noun", "merged")


@query("""WITH d AS (SELECT 'p-' || doc_id AS page, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY 'p-' || doc_id) AS n FROM documents)
SELECT page, 'wiki/' || source || '/' || lang || CASE WHEN n = 1 THEN '' WHEN n = 2 THEN '-2' ELSE '-' || (n + 1) END AS slug FROM d""")
def g08_slugs(spark, sf_dir):
    """Every page proposes the same name for its source and language; number 3 is taken by a mesh."""
    return _same_names(spark, sf_dir).select("page", "slug")


def _same_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    none = F.lit(None).cast("string")
    rows = docs.select(F.concat(F.lit("p-"), F.col("doc_id").cast("string")).alias("page"), F.lit(0).alias("ord"), F.array().cast("array<string>").alias("heading_chain"), F.col("lang").alias("noun"), F.col("source").alias("subdir"), none.alias("title"), none.alias("extends"))
    held = docs.select(F.concat_ws("/", F.lit("wiki"), "source", F.concat("lang", F.lit("-3"))).alias("mesh")).distinct()
    return scaffold.name_drafts(rows, held)


@query("SELECT 'p-' || doc_id AS page, CASE WHEN doc_id % 2 = 0 THEN 'Sub' ELSE 'Title ' || doc_id || ',Sub' END AS chain FROM documents")
def g09_trim_chain(spark, sf_dir):
    ident = F.col("doc_id").cast("string")
    rows = _docs(spark, sf_dir).select(F.concat(F.lit("p-"), ident).alias("page"), F.array(F.concat(F.lit("Title "), ident), F.lit("Sub")).alias("heading_chain"), F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit(" TITLE  ")).otherwise("Other "), ident).alias("title"))
    return scaffold.trim_chain(rows.drop("title"), rows.select("page", "title")).select("page", F.array_join("heading_chain", ",").alias("chain"))


# Snapshots -------------------------------------------------------------------

_FILES = """files AS (SELECT doc_id AS d, 'wiki/' || source || '/' || lang || '/doc-' || doc_id || '.md' AS path, sha256(coalesce(text, '')) AS h FROM documents),
before AS (SELECT path, h || CASE WHEN d % 17 = 6 THEN 'b' ELSE '' END AS h FROM files WHERE d % 4 <> 0),
head AS (SELECT path, h FROM files WHERE d % 5 <> 0),
index AS (SELECT path, h || CASE WHEN d % 11 = 3 THEN 's' ELSE '' END AS h FROM files WHERE d % 7 <> 0 AND d % 6 <> 5),
work AS (SELECT path, h || CASE WHEN d % 11 = 3 THEN 's' ELSE '' END || CASE WHEN d % 9 = 4 THEN 'w' ELSE '' END AS h FROM files WHERE d % 13 <> 0)"""


def _trees(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Trees of a revision before, the present one, the index and the work tree, as in ``_FILES``."""
    d = F.col("doc_id")
    files = _corpus(spark, sf_dir).select("doc_id", F.col("path_rel").alias("path"), F.col("content_hash").alias("h"))
    mark = lambda when, x: F.when(when, F.lit(x)).otherwise(F.lit(""))
    rows = {
        "before": files.where(d % 4 != 0).withColumn("h", F.concat("h", mark(d % 17 == 6, "b"))),
        "head": files.where(d % 5 != 0),
        "index": files.where((d % 7 != 0) & (d % 6 != 5)).withColumn("h", F.concat("h", mark(d % 11 == 3, "s"))),
        "work": files.where(d % 13 != 0).withColumn("h", F.concat("h", mark(d % 11 == 3, "s"), mark(d % 9 == 4, "w"))),
    }
    return {k: snapshots.tree(v.select("path", F.col("h").alias("content_hash"))) for k, v in rows.items()}


def _status_sql(head: str) -> str:
    change = "CASE WHEN {0}.h IS NULL THEN 'added' WHEN {1}.h IS NULL THEN 'deleted' WHEN {0}.h <> {1}.h THEN 'changed' END"
    return f"""status AS (SELECT * FROM (SELECT coalesce({head}.path, index.path, work.path) AS path,
    CASE WHEN {head}.h IS NULL AND index.h IS NULL THEN NULL ELSE {change.format(head, 'index')} END AS staged, CASE WHEN index.h IS NOT NULL THEN {change.format('index', 'work')} END AS unstaged, index.h IS NULL AND work.h IS NOT NULL AS untracked
  FROM {head} FULL JOIN index ON {head}.path = index.path FULL JOIN work ON coalesce(index.path, {head}.path) = work.path) WHERE staged IS NOT NULL OR unstaged IS NOT NULL OR untracked)"""


@query(f"WITH {_FILES}, {_status_sql('head')} SELECT path, staged, unstaged, untracked FROM status")
def i09_tree_status(spark, sf_dir):
    t = _trees(spark, sf_dir)
    return snapshots.status(t["head"], t["index"], t["work"])


@query(f"WITH {_FILES}, none AS (SELECT * FROM files WHERE false), {_status_sql('none')} SELECT path, staged, unstaged, untracked FROM status")
def i10_tree_no_head(spark, sf_dir):
    t = _trees(spark, sf_dir)
    return snapshots.status(None, t["index"], t["work"])


@query(f"""WITH {_FILES}, {_status_sql('head')}, looked AS (SELECT path FROM status UNION SELECT coalesce(before.path, head.path) FROM before FULL JOIN head ON before.path = head.path WHERE before.h IS DISTINCT FROM head.h)
SELECT path, CASE WHEN work.h IS NULL THEN 'deleted' ELSE 'changed_or_added' END AS change FROM looked LEFT JOIN work USING (path) WHERE work.h IS NOT NULL OR path IN (SELECT path FROM before)""")
def i13_candidates(spark, sf_dir):
    t = _trees(spark, sf_dir)
    return snapshots.candidates(t["before"], t["head"], t["index"], t["work"], t["before"].where("kind = 'file'"))


#: Pages that move and lose a third of their lines: contents are paired by common lines, the best pair first.
_EDITED = r"""WITH RECURSIVE o AS (SELECT 'old/' || doc_id || '.md' AS path, coalesce(text, '') AS x FROM documents),
n AS (SELECT 'new/' || doc_id || '.md' AS path, array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x, i: i % 3 <> 0), chr(10)) AS x FROM documents),
op AS (SELECT path, x, row_number() OVER (PARTITION BY x ORDER BY path) AS k FROM o), np AS (SELECT path, x, row_number() OVER (PARTITION BY x ORDER BY path) AS k FROM n),
oc AS (SELECT *, row_number() OVER (ORDER BY first) AS id FROM (SELECT x, min(path) AS first, count(*) AS c FROM o GROUP BY x)), nc AS (SELECT *, row_number() OVER (ORDER BY first) AS id FROM (SELECT x, min(path) AS first, count(*) AS c FROM n GROUP BY x)),
ou AS (SELECT oc.id, oc.x, oc.first, least(oc.c, coalesce(nc.c, 0)) AS used, oc.c - least(oc.c, coalesce(nc.c, 0)) AS free FROM oc LEFT JOIN nc USING (x)), nu AS (SELECT nc.id, nc.x, nc.first, least(nc.c, coalesce(oc.c, 0)) AS used, nc.c - least(nc.c, coalesce(oc.c, 0)) AS free FROM nc LEFT JOIN oc USING (x)),
ol AS (SELECT id, l, count(*) AS c, max(strlen(l) + 1) AS w FROM (SELECT id, unnest(string_split(x, chr(10))) AS l FROM ou WHERE free > 0) GROUP BY id, l), nl AS (SELECT id, l, count(*) AS c FROM (SELECT id, unnest(string_split(x, chr(10))) AS l FROM nu WHERE free > 0) GROUP BY id, l),
shared AS (SELECT ol.id AS oi, nl.id AS ni, sum(least(ol.c, nl.c) * w) AS s FROM ol JOIN nl USING (l) GROUP BY ol.id, nl.id),
pair AS (SELECT *, row_number() OVER (ORDER BY score DESC, ofirst, nfirst) AS k FROM (SELECT oi, ni, ou.first AS ofirst, nu.first AS nfirst, s / greatest(strlen(ou.x) + 1, strlen(nu.x) + 1) AS score FROM shared JOIN ou ON ou.id = oi JOIN nu ON nu.id = ni) WHERE score >= 0.5),
walk AS (SELECT 0::BIGINT AS k, (SELECT list(free ORDER BY id) FROM ou) AS lo, (SELECT list(free ORDER BY id) FROM nu) AS ln, 0::BIGINT AS oi, 0::BIGINT AS ni, 0::BIGINT AS take, 0::BIGINT AS o_left, 0::BIGINT AS n_left, 0::DOUBLE AS score
  UNION ALL SELECT p.k, list_transform(lo, lambda x, i: CASE WHEN i = p.oi THEN x - least(lo[p.oi], ln[p.ni]) ELSE x END), list_transform(ln, lambda x, i: CASE WHEN i = p.ni THEN x - least(lo[p.oi], ln[p.ni]) ELSE x END), p.oi, p.ni, least(lo[p.oi], ln[p.ni]), lo[p.oi], ln[p.ni], p.score
  FROM walk JOIN pair p ON p.k = walk.k + 1),
taken AS (SELECT w.*, ou.x AS ox, nu.x AS nx, ou.used + ou.free - o_left AS o_from, nu.used + nu.free - n_left AS n_from FROM walk w JOIN ou ON ou.id = w.oi JOIN nu ON nu.id = w.ni WHERE take > 0)
SELECT op.path AS old, np.path AS new, 1.0::DOUBLE AS score FROM op JOIN np USING (x, k)
UNION ALL SELECT op.path, np.path, round(score, 6) FROM (SELECT *, unnest(range(1, take + 1)) AS i FROM taken) t JOIN op ON op.x = ox AND op.k = o_from + i JOIN np ON np.x = nx AND np.k = n_from + i"""


@query(_EDITED)
def i11_renames_edited(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: i % 3 != 2), "\n")
    page = lambda top, content: _docs(spark, sf_dir).select(F.concat(F.lit(f"{top}/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), content.alias("content"))
    return snapshots.renames(page("old", text), page("new", kept)).withColumn("score", F.round("score", 6))


#: Every document's page is renamed, its name is used again, both move on, and some are deleted.
_REVISIONS = """revisions AS (SELECT 10 * doc_id + r AS rev, s AS status, CASE p WHEN 'c' THEN 'c/' || (doc_id % 2) || '/' || doc_id ELSE p || '/' || doc_id END AS path, CASE WHEN s = 'R' THEN o || '/' || doc_id END AS old_path
  FROM documents, (VALUES (0, 'A', 'a', ''), (1, 'M', 'a', ''), (2, 'R', 'b', 'a'), (3, 'A', 'a', ''), (4, 'R', 'c', 'b'), (5, 'M', 'a', ''), (6, 'R', 'b', 'a'), (7, 'D', 'b', '')) v(r, s, p, o) WHERE r < 7 OR doc_id % 3 = 0)"""


@query(f"""WITH RECURSIVE {_REVISIONS}, birth AS (SELECT rev, path, CASE WHEN status = 'R' THEN old_path END AS source FROM revisions WHERE status IN ('A', 'R')),
gone AS (SELECT path, rev FROM revisions WHERE status = 'D' UNION ALL SELECT old_path, rev FROM revisions WHERE status = 'R'),
present AS (SELECT path, max(rev) AS born FROM birth GROUP BY path), alive AS (SELECT path, born FROM present WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.path = present.path AND gone.rev > born)),
walk AS (SELECT alive.path, alive.path AS name, born, CAST(NULL AS BIGINT) AS ended, source FROM alive JOIN birth ON birth.path = alive.path AND rev = born
  UNION ALL SELECT w.path, b.path, b.rev, w.born, b.source FROM walk w JOIN birth b ON b.path = w.source AND b.rev < w.born AND NOT EXISTS (SELECT 1 FROM birth c WHERE c.path = b.path AND c.rev > b.rev AND c.rev < w.born))
SELECT walk.path, row_number() OVER (PARTITION BY walk.path ORDER BY r.rev DESC) - 1 AS ord, r.rev, name FROM walk JOIN revisions r ON r.path = name AND r.status <> 'D' AND r.rev >= born AND (ended IS NULL OR r.rev < ended)""")
def i12_history(spark, sf_dir):
    steps = [(0, "A", "a", None), (1, "M", "a", None), (2, "R", "b", "a"), (3, "A", "a", None), (4, "R", "c", "b"), (5, "M", "a", None), (6, "R", "b", "a"), (7, "D", "b", None)]
    events = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(s).alias("status"), F.lit(p).alias("p"), F.lit(o).cast("string").alias("o")) for r, s, p, o in steps])
    ident = F.col("doc_id").cast("string")
    path = F.when(F.col("p") == "c", F.concat(F.lit("c/"), (F.col("doc_id") % 2).cast("string"), F.lit("/"), ident)).otherwise(F.concat("p", F.lit("/"), ident))
    rows = _docs(spark, sf_dir).select("doc_id", F.inline(events)).where("r < 7 or doc_id % 3 = 0")
    return snapshots.history(rows.select((10 * F.col("doc_id") + F.col("r")).alias("rev"), "status", path.alias("path"), F.concat("o", F.lit("/"), ident).alias("old_path"))).withColumn("ord", F.col("ord").cast("long"))


@query(ORACLES["c06_all_diagnostics"])
def i14_incremental_checks(spark, sf_dir):
    """The findings of c06, reached by a change: some pages came, some were longer before, some had other headings, others went."""
    pages, d = _pages(spark, sf_dir), F.regexp_extract("path", "doc-([0-9]+)", 1).cast("long")
    none = C.corpus_of(pages.limit(0))
    other = F.when(d % 9 == 2, F.concat("content", F.lit("\nmore\nmore [see](/wiki/doc-1.md#L900-L901)"))).when(d % 9 == 5, F.regexp_replace("content", "Part 1", "Part 7")).otherwise(F.col("content"))
    before = pages.where(d % 10 != 3).withColumn("content", other).unionByName(pages.where(d % 25 == 0).withColumn("path", F.regexp_replace("path", "^wiki/", "gone/")))
    old = recheck.facts(before, none, before.select("path"))
    changed = pages.where((d % 10 == 3) | (d % 9).isin(2, 5))
    anchors = _anchors(_links(pages))
    found = written(recheck.findings(old, anchors), "findings")
    deleted = before.where(F.col("path").startswith("gone/")).select("path")
    return recheck.recheck(old, found, recheck.facts(changed, none, changed.select("path")), deleted, anchors)[1]


_SESSIONS = """e AS (SELECT user_id::VARCHAR AS session, epoch_us(ts) // 1000 AS ms, CASE WHEN event_type <> 'error' THEN 'wiki/doc-' || (event_id % 200) || '.md' END AS path FROM events),
o AS (SELECT *, row_number() OVER w AS n, CASE WHEN lag(ms) OVER w IS NULL OR ms - lag(ms) OVER w > 6 * 3600000 OR lag(path) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM e WINDOW w AS (PARTITION BY session ORDER BY ms, path IS NULL, path)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY session ORDER BY n) AS g FROM o)"""


@query(f"""WITH {_SESSIONS} SELECT session, make_timestamp(min(ms) * 1000) AS started, make_timestamp(max(ms) * 1000) AS ended, CASE WHEN bool_or(path IS NULL) THEN 'stop' ELSE 'gap' END AS reason,
  count(path) AS edits, array_to_string(list_sort(list(DISTINCT path) FILTER (path IS NOT NULL)), ',') AS paths FROM g GROUP BY session, g HAVING count(path) > 0""")
def i15_edit_sessions(spark, sf_dir):
    """Sessions of users over ``events``: an error stops one, and so does a gap of six hours; a fifth of the events arrive a batch later."""
    folder, cuts = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}", 4
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("session"), F.when(F.col("event_type") != "error", F.concat(F.lit("wiki/doc-"), (F.col("event_id") % 200).cast("string"), F.lit(".md"))).alias("path"), "event_id")
    batch = F.least(F.floor((F.dayofmonth("ts") - 1) * cuts / 30) + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0), F.lit(cuts))
    events.where("ts is not null").withColumn("batch", batch.cast("int")).drop("event_id").write.partitionBy("batch").parquet(f"{folder}/cut")
    spark.range(1).select(F.lit("2200-01-01").cast("timestamp").alias("ts"), F.lit("").alias("session"), F.lit(None).cast("string").alias("path")).write.parquet(f"{folder}/end")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(hadoop(f"{folder}/fed"))
    for source in [*(f"cut/batch={b}" for b in range(cuts + 1)), "end"]:
        if fs.exists(hadoop(f"{folder}/{source}")):
            fs.rename(hadoop(f"{folder}/{source}"), hadoop(f"{folder}/fed/{source.replace('/', '-').replace('=', '-')}"))
            stream = spark.readStream.schema("ts timestamp, session string, path string").option("recursiveFileLookup", "true").parquet(f"{folder}/fed")
            # events may arrive two cuts late, by which time nothing of theirs is settled
            sessions.ended(stream, "6 hours", "16 days").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(sessions.ENDED).parquet(f"{folder}/out").withColumn("paths", F.array_join("paths", ","))


#: Rules (dir, ord, pattern), and what each matches as a regular expression over whole paths: kind (a any, d directories), taken back or not.
_RULES = [
    ("", 0, "# notes"), ("", 1, "doc-*7.md"), ("", 2, "/wiki/src1/"), ("", 3, "fr"), ("", 4, "!doc-17.md"), ("", 5, "wiki/**/es/doc-?.md"), ("", 6, "de/**"),
    ("wiki/src2", 0, "!fr/"), ("wiki/src2", 1, "fr/doc-*[02].md"), ("wiki/src2/de", 0, "!doc-1*"), ("wiki/src3", 0, "*.md"), ("wiki/src3", 1, "!e[nx]/**/*.md"), ("wiki/src3/en", 0, "doc-*5.*"), ("wiki/src4", 0, "  "), ("wiki/src4", 1, "/en/doc-*0.md"),
]
_RULES_SQL = [
    (0, 1, "a", False, "(.*/)?doc-[^/]*7[.]md"), (0, 2, "d", False, "wiki/src1"), (0, 3, "a", False, "(.*/)?fr"), (0, 4, "a", True, "(.*/)?doc-17[.]md"), (0, 5, "a", False, "wiki/(.*/)?es/doc-[^/][.]md"), (0, 6, "a", False, "de/.+"),
    (2, 0, "d", True, "wiki/src2/(.*/)?fr"), (2, 1, "a", False, "wiki/src2/fr/doc-[^/]*[02][.]md"), (3, 0, "a", True, "wiki/src2/de/(.*/)?doc-1[^/]*"), (2, 0, "a", False, "wiki/src3/(.*/)?[^/]*[.]md"), (2, 1, "a", True, "wiki/src3/e[nx]/(.*/)?[^/]*[.]md"), (3, 0, "a", False, "wiki/src3/en/(.*/)?doc-[^/]*5[.][^/]*"), (2, 1, "a", False, "wiki/src4/en/doc-[^/]*0[.]md"),
]


@query(f"""WITH {CORPUS}, rules(depth, ord, kind, again, re) AS (VALUES {', '.join(f"({a}, {b}, '{k}', {n}, '^{r}$')" for a, b, k, n, r in _RULES_SQL)}),
part AS (SELECT path_rel AS path, string_split(path_rel, '/') AS p FROM corpus), node AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS node, i = len(p) AS file FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM part)),
gone AS (SELECT node FROM (SELECT node, arg_max(again, depth * 100 + ord) AS again FROM node JOIN rules ON (kind = 'a' OR NOT file) AND regexp_matches(node, re) GROUP BY node) WHERE NOT again)
SELECT path FROM part WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.node = part.path OR starts_with(part.path, gone.node || '/'))""")
def i16_walk_ignores(spark, sf_dir):
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("dir"), F.lit(b).alias("ord"), F.lit(c).alias("pattern")) for a, b, c in _RULES])))
    return ignore.walk(_corpus(spark, sf_dir).select(F.col("path_rel").alias("path")), rules)


# Rows for operators over derived inputs ---------------------------------------

#: Of each link on a made-up page: what stands before its href, the href, its kind, target, fragment and range.
_LINKED = [
    ("'Intro é [a](' ", "'https://example.org/d?id=' || doc_id || '#top'", "external", "'https://example.org/d?id=' || doc_id", "'top'", "NULL", "NULL", 1),
    ("') and ![m]('", "'mailto:x' || doc_id || '@y.z'", "external", "'mailto:x' || doc_id || '@y.z'", "NULL", "NULL", "NULL", 1),
    ("') end' || chr(10) || '`[no](code.md)` [über]('", "'../doc-' || (doc_id + 1) || '.md#part-' || doc_id % 5", "internal", "'../doc-' || (doc_id + 1) || '.md'", "'part-' || doc_id % 5", "NULL", "NULL", 2),
    ("')' || chr(10) || chr(10) || '[p]('", "'/wiki/doc-' || doc_id || '.md#L' || (doc_id % 9 + 1) || '-L' || (doc_id % 9 + 4)", "internal", "'/wiki/doc-' || doc_id || '.md'", "'L' || (doc_id % 9 + 1) || '-L' || (doc_id % 9 + 4)", "doc_id % 9 + 1", "doc_id % 9 + 4", 4),
]
_LINKED_ROWS = " UNION ALL ".join(
    f"SELECT 'wiki/doc-' || doc_id || '.md' AS path, {i} AS ordinal, '{kind}' AS kind, {target} AS target, {fragment} AS fragment, CAST({a} AS INT) AS start_line, CAST({b} AS INT) AS end_line, {href} AS href, {line} AS source_line, strlen({' || '.join(f'{x[0]} || {x[1]}' for x in _LINKED[:i])}{' || ' if i else ''}{before}) AS byte_start FROM documents"
    for i, (before, href, kind, target, fragment, a, b, line) in enumerate(_LINKED)
)


def _linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): an external link, a mail address, a link to a heading and one to lines on each page, and one in code."""
    ident = F.col("doc_id")
    text = lambda n: n.cast("string")
    content = F.concat(
        F.lit("Intro é [a](https://example.org/d?id="), text(ident), F.lit("#top) and ![m](mailto:x"), text(ident), F.lit("@y.z) end\n`[no](code.md)` [über](../doc-"), text(ident + 1), F.lit(".md#part-"), text(ident % 5),
        F.lit(")\n\n[p](/wiki/doc-"), text(ident), F.lit(".md#L"), text(ident % 9 + 1), F.lit("-L"), text(ident % 9 + 4), F.lit(")\n"),
    )
    return _docs(spark, sf_dir).select(F.concat(F.lit("wiki/doc-"), text(ident), F.lit(".md")).alias("path"), content.alias("content"))


@query(f"SELECT *, byte_start + strlen(href) AS byte_end FROM ({_LINKED_ROWS})")
def m10_link_places(spark, sf_dir):
    return md.links(_linked_pages(spark, sf_dir)).drop("text").withColumns({c: F.col(c).cast("long") for c in ("byte_start", "byte_end")})


@query("""SELECT 'wiki/doc-' || doc_id || '.md' AS file, CASE WHEN k = 0 THEN 2 ELSE 4 END AS line, CASE WHEN k = 0 THEN 'File `../doc-' || (doc_id + 1) || '.md` not found.' ELSE 'Line range `L' || (doc_id % 9 + 1) || '–L' || (doc_id % 9 + 4) || '` exceeds `/wiki/doc-' || doc_id || '.md` (4 lines).' END AS message
FROM documents, (VALUES (0), (1)) v(k) WHERE k = 0 OR doc_id % 9 > 0""")
def c10_no_finding_for_external_links(spark, sf_dir):
    pages = _linked_pages(spark, sf_dir)
    links = md.links(pages)
    return check.broken_links(links, pages.select("path")).unionByName(check.broken_ranges(links, pages)).select("file", "line", "message")


@query(rf"""WITH l AS (SELECT 'doc-' || doc_id AS path, unnest(range(1, len(p) + 1)) AS line, unnest(p) AS x FROM (SELECT doc_id, string_split(replace(coalesce(text, ''), '#', ''), chr(10)) AS p FROM documents)),
b AS (SELECT path, line, line % 4 = 0 OR {_TRIM.format('x')} = '' AS blank FROM l), g AS (SELECT *, sum(blank::INT) OVER (PARTITION BY path ORDER BY line) AS g FROM b),
w AS (SELECT *, min(line) FILTER (NOT blank) OVER (PARTITION BY path, g) AS low, max(line) FILTER (NOT blank) OVER (PARTITION BY path, g) AS high FROM g)
SELECT path, line, CASE WHEN blank THEN line ELSE low END AS section_start, greatest(line, coalesce(high, line)) AS section_end FROM w""")
def m11_paragraphs(spark, sf_dir):
    """Pages without a heading: the section of a line is its paragraph."""
    lines = F.transform(F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("#"), F.lit("")), "\n", -1), lambda x, i: F.when(i % 4 == 3, F.lit("")).otherwise(x))
    pages = _docs(spark, sf_dir).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), F.array_join(lines, "\n").alias("content"))
    rows = md.sections(md.outline_lines(pages)).where(F.size("heading_chain") == 0)
    return rows.select("path", *[F.col(c).cast("long").alias(c) for c in ("line", "section_start", "section_end")])


_FOUND = "SELECT CASE doc_id % 4 WHEN 0 THEN 'wiki/' || lang || '/doc-' || doc_id || '.md' WHEN 1 THEN 'pkg/tests/fixtures/doc-' || doc_id || '.md' WHEN 2 THEN 'src/doc-' || doc_id || '.rs' ELSE 'notes/deep/er/n' || doc_id || '.md' END AS path FROM documents"


@query(f"WITH f AS ({_FOUND}) SELECT path, 'default' AS how FROM f WHERE path LIKE '%.md' AND NOT contains(path, '/tests/fixtures/') UNION ALL SELECT path, 'globs' FROM f WHERE path LIKE '%.md' AND (regexp_matches(path, '^wiki/.*/doc-[^/]*[13579]?0[.]md$') OR starts_with(path, 'notes/') AND regexp_matches(path, 'n1.*5[.]md$'))")
def l08_discovery(spark, sf_dir):
    ident = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 4
    path = F.when(kind == 0, F.concat(F.lit("wiki/"), "lang", F.lit("/doc-"), ident, F.lit(".md"))).when(kind == 1, F.concat(F.lit("pkg/tests/fixtures/doc-"), ident, F.lit(".md"))).when(kind == 2, F.concat(F.lit("src/doc-"), ident, F.lit(".rs"))).otherwise(F.concat(F.lit("notes/deep/er/n"), ident, F.lit(".md")))
    pages = _docs(spark, sf_dir).select(path.alias("path"))
    return C.discover(pages).withColumn("how", F.lit("default")).unionByName(C.discover(pages, ["./wiki/**/doc-*0.md", "notes/*n1*5.md"]).withColumn("how", F.lit("globs")))


@query("SELECT source || '/m' || (doc_id % 7) AS mesh, 'wiki/doc-' || doc_id || '.md' AS path, CAST(doc_id % 40 AS INT) AS start_line, CAST(doc_id % 40 + doc_id % 3 AS INT) AS end_line FROM documents WHERE doc_id % 5 <> 0")
def i17_mesh_anchors(spark, sf_dir):
    d, text = F.col("doc_id"), lambda n: n.cast("string")
    line = F.concat("source", F.lit("/m"), text(d % 7), F.lit("\twiki/doc-"), text(d), F.lit(".md\t"), text(d % 40), F.lit("-"), text(d % 40 + d % 3))
    return mesh.parse_anchors(_docs(spark, sf_dir).select(F.when(d % 10 == 0, F.lit("  ")).when(d % 10 == 5, F.lit(mesh.EMPTY)).otherwise(line).alias("value")))


@query("""SELECT CASE doc_id % 3 WHEN 0 THEN 'MOVED' ELSE 'CHANGED' END AS code, 'm' || (doc_id % 7) AS mesh, 'wiki/doc-' || doc_id || '.md' AS path, CAST(k AS INT) AS start_line, CAST(k + doc_id % 9 AS INT) AS end_line,
CASE WHEN doc_id % 3 = 0 THEN 'new/doc-' || doc_id || '.md' END AS new_path, CASE WHEN doc_id % 3 = 0 THEN CAST(k + 5 AS INT) END AS new_start, CASE WHEN doc_id % 3 = 0 THEN CAST(k + 5 + doc_id % 9 AS INT) END AS new_end FROM documents, (VALUES (1), (20)) v(k)""")
def i18_mesh_drift(spark, sf_dir):
    d, ident = F.col("doc_id"), F.col("doc_id").cast("string")
    span = lambda path, a, b: F.struct(path.alias("path"), F.struct(a.cast("int").alias("start"), b.cast("int").alias("end")).alias("extent"))
    one = lambda k: F.struct(F.struct(F.when(d % 3 == 0, F.lit("MOVED")).otherwise("CHANGED").alias("code")).alias("status"), F.concat(F.lit("m"), (d % 7).cast("string")).alias("mesh"), span(F.concat(F.lit("wiki/doc-"), ident, F.lit(".md")), F.lit(k), k + d % 9).alias("anchored"), F.when(d % 3 == 0, span(F.concat(F.lit("new/doc-"), ident, F.lit(".md")), F.lit(k + 5), k + 5 + d % 9)).alias("moved_to"))
    return mesh.parse_drift(_docs(spark, sf_dir).select(F.to_json(F.struct(F.array(one(1), one(20)).alias("findings"))).alias("value")))


@query("SELECT event_type AS event, count(*) AS n, max(round(value, 3)) AS max_ms, count(*) FILTER (event_id % 3 = 0) AS failed FROM events GROUP BY event_type")
def i19_event_log(spark, sf_dir):
    """Events are added to a log of JSON lines in two parts and read back."""
    folder = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), F.col("event_id").cast("string").alias("invocation_id"), F.col("event_type").alias("event"), F.col("value").alias("duration_ms"),
        F.when(F.col("event_id") % 3 == 0, F.lit("error")).otherwise("ok").alias("status"), F.struct(F.col("user_id").alias("user")).alias("meta"), (F.col("event_id") % 2).alias("half"),
    )
    for half in (0, 1):
        sinks.append_log(folder, events.where(F.col("half") == half).drop("half"))
    return mesh.read_log(spark.read.text(folder)).groupBy("event").agg(F.count("*").alias("n"), F.max(F.round("duration_ms", 3)).alias("max_ms"), F.count(F.when(F.col("status") == "error", 1)).alias("failed"))


# Sinks that commit at once ----------------------------------------------------

@query(f"WITH {CORPUS} SELECT row_number() OVER (ORDER BY title, path_rel) - 1 AS position, path_rel AS path, title, aliases[1] AS alias FROM corpus")
def k05_json_array(spark, sf_dir):
    """All pages as one ordered JSON array of many parts, read back."""
    folder = f"{shared_dir(spark)}/array-{uuid.uuid4().hex}"
    sinks.write_array(folder, _corpus(spark, sf_dir).select(F.col("path_rel").alias("path"), "title", F.get("aliases", F.lit(0)).alias("alias")), ["title", "path"])
    return sinks.read_array(spark, folder, "path string, title string, alias string").select("position", "row.*")


@query(f"WITH {CORPUS} SELECT path_rel AS path, content_hash FROM corpus")
def k06_page_tree(spark, sf_dir):
    """All pages as files of a folder that appears at once, read back."""
    folder = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    sinks.write_tree(folder, _corpus(spark, sf_dir).select(F.col("path_rel").alias("path"), "content"))
    return C.read_pages(spark, folder).select("path", F.sha2("content", 256).alias("content_hash"))


@query("""WITH d AS (SELECT doc_id, 'p-' || doc_id AS path, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY 'p-' || doc_id) AS n FROM documents),
s AS (SELECT doc_id, path, 'wiki/' || source || '/' || lang || CASE WHEN n = 1 THEN '' WHEN n = 2 THEN '-2' ELSE '-' || (n + 1) END AS slug FROM d)
SELECT row_number() OVER (ORDER BY path) - 1 AS position, path, '' AS title, slug, CAST(1 AS BIGINT) AS meshes, path || '.md' AS anchor, CAST(doc_id % 50 + 1 AS INT) AS end_line FROM s""")
def g10_proposal_array(spark, sf_dir):
    """The proposals of all pages as one ordered JSON array, read back."""
    folder = f"{shared_dir(spark)}/proposal-{uuid.uuid4().hex}"
    anchor = F.struct(F.concat("page", F.lit(".md")).alias("path"), F.lit(1).alias("start_line"), (F.substring_index("page", "-", -1).cast("long") % 50 + 1).cast("int").alias("end_line"))
    rows = _same_names(spark, sf_dir).withColumn("anchors", F.array(anchor))
    none = spark.createDataFrame([], "slug string, missing_path string, page string, path string, category string, message string")
    scaffold.write_json(folder, rows, none, none)
    back = sinks.read_array(spark, f"{folder}/pages", "path string, title string, meshes array<struct<slug: string, anchors: array<struct<path: string, endLine: int>>>>").select("position", "row.*")
    first = F.col("meshes")[0]
    return back.select("position", "path", "title", first["slug"].alias("slug"), F.size("meshes").cast("long").alias("meshes"), first["anchors"][0]["path"].alias("anchor"), first["anchors"][0]["endLine"].alias("end_line"))
