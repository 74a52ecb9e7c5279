"""Command line over a git repository: ``python -m inkgraph [command] ...``; without a command the words are a search."""

from __future__ import annotations

import argparse
import os
import subprocess
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import markdown as md
from .operators import check, fix, lookup, scaffold, search, sync
from .session import session
from .sources import corpus as C
from .sources import git, mesh, sinks

COMMANDS = ("check", "links", "refs", "list", "summary", "scaffold", "hook")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkgraph", description=__doc__)
    p.add_argument("words", nargs="*", help="a command with its inputs, or a search query")
    p.add_argument("--source", choices=["worktree", "index", "head"], default="worktree")
    p.add_argument("--json", action="store_true")
    p.add_argument("-l", "--limit", type=int, default=search.DEFAULT_LIMIT)
    p.add_argument("-o", "--offset", type=int, default=0)
    p.add_argument("--tag")
    p.add_argument("--fix", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--no-mesh", action="store_true")
    p.add_argument("--no-exit-code", action="store_true")
    p.add_argument("--anchors", help="file of coverage anchors: mesh, path and start-end between tabs")
    return p


def repo_root() -> str:
    return subprocess.run(["git", "rev-parse", "--show-toplevel"], check=True, capture_output=True, text=True).stdout.strip()


def _show(rows: DataFrame, as_json: bool, text=None) -> None:
    """Results on standard output; they are meant for a reader, so they are small."""
    values = sinks.json_rows(rows) if as_json or text is None else rows.select(text.alias("value"))
    lines = [r.value for r in values.toLocalIterator()]
    print("[" + ",\n ".join(lines) + "]" if as_json else "\n".join(lines))


class Run:
    def __init__(self, spark: SparkSession, options: argparse.Namespace):
        self.spark, self.options = spark, options
        git.register(spark)
        self.root = repo_root()
        self.files = spark.read.format("git_snapshot").option("repo", self.root).option("snapshot", options.source).load().persist()
        self.pages = C.default_discovery(self.files).select("path", "content")
        self.corpus = C.corpus_of(self.pages)
        self.paths = self.files.select("path")

    def links(self) -> DataFrame:
        return C.links_of(md.links(self.pages.where("content is not null")))

    def anchors(self) -> DataFrame | None:
        return mesh.parse_anchors(self.spark.read.text(self.options.anchors)) if self.options.anchors else None

    def inputs(self, words: list[str]) -> list[str]:
        given = words or ([] if sys.stdin.isatty() else [x.strip() for x in sys.stdin])
        return [x for x in given if x]

    def search(self, words: list[str]) -> int:
        o = self.options
        rows = search.search(self.corpus, " ".join(words), o.limit, o.offset, self.root).orderBy("position").persist()
        if o.json:
            _show(rows.drop("position", "total"), True)
        else:
            print("\n\n".join(r.value for r in sinks.result_text(rows).orderBy("position").collect()))
            first = rows.select(search.remaining("total", o.offset, F.lit(rows.count())).alias("n")).first()
            if first and first.n:
                print(f"\n{first.n} other matches")
        return 0

    def summary(self, words: list[str]) -> int:
        names = self.spark.createDataFrame([(x,) for x in self.inputs(words)], "input string")
        rows = lookup.summaries(self.corpus, names).persist()
        _show(rows.where("code = 0").select("title", F.col("path_rel").alias("file"), "summary"), self.options.json, F.concat_ws("\n", F.concat(F.lit("# "), "title"), "file", "summary"))
        for r in rows.where("code = 1").collect():
            print(f"`{r.input}` not found.", *[f"Did you mean `{s.title}`?" for s in search.suggest(self.corpus, r.input).collect()], file=sys.stderr)
        return lookup.exit_code(rows).first().code

    def refs(self, words: list[str]) -> int:
        known = 0
        for x in self.inputs(words):
            found = lookup.resolve_pages(self.corpus, lookup.one_input(self.spark, x)).first()
            known = max(known, int(found is None))
            if found:
                _show(lookup.refs(self.corpus, self.links(), x), self.options.json, F.format_string("%s:%d: %s", "source_file", "line", "text"))
        return known

    def backlinks(self, words: list[str]) -> int:
        for x in self.inputs(words):
            found = lookup.resolve_pages(self.corpus, lookup.one_input(self.spark, x)).first()
            target = found.path_rel if found else x
            _show(lookup.backlinks(self.corpus, self.links(), target), self.options.json, F.concat_ws("\n", F.concat(F.lit("# "), "title"), "path_rel", F.array_join(F.transform("snippets", lambda s: s["text"]), "\n")))
            if not found and "/" not in x and not x.endswith(".md"):
                print(*[f"Did you mean `{s.title}`?" for s in search.suggest(self.corpus, x).collect()], sep="\n", file=sys.stderr)
        return 0

    def list(self, words: list[str]) -> int:
        _show(lookup.list_pages(self.corpus, self.options.tag), self.options.json, F.concat_ws("\n", F.concat(F.lit("# "), "title"), "path_rel", "summary", F.array_join("tags", ", ")))
        return 0

    def check(self, words: list[str]) -> int:
        o = self.options
        pages = C.discover(self.files, words).select("path", "content") if words else self.pages
        # without globs only members of the corpus are looked at
        scope = pages.select("path") if words else self.corpus.select(F.col("path_rel").alias("path"))
        every = self.pages.unionByName(pages).distinct() if words else pages
        with_mesh = not o.no_mesh and o.source == "worktree"
        if o.fix:
            if o.source != "worktree":
                print("repairs need the work tree", file=sys.stderr)
                return 2
            moves = self.spark.createDataFrame(git.renames(self.root) + git.renames(self.root, staged=True), "old string, new string").distinct()
            names = [r.path for r in pages.select("path").collect()]
            history = self.spark.createDataFrame([v for n in names for v in git.history(self.root, n)], "path string, ord int, content string")
            fixes, skipped, patched = fix.fix(pages.where("content is not null"), self.paths, moves, history)
            _show(fixes, o.json)
            _show(skipped, o.json)
            if not o.dry_run:
                for r in patched.join(fixes.select(F.col("file").alias("path")).distinct(), "path").collect():
                    with open(os.path.join(self.root, r.path), "w", encoding="utf-8", newline="") as f:
                        f.write(r.content)
            return 0
        found = check.check(every, self.corpus, self.paths, self.anchors(), mesh=with_mesh, scope=scope).persist()
        if o.json:
            print(sinks.json_envelope(found, "errors").first().value)
        else:
            print("\n\n".join(r.value for r in sync.diagnostics_text(found.orderBy("file", "line", "kind")).collect()))
        return check.check_code(found, o.no_exit_code).first().code

    def scaffold(self, words: list[str]) -> int:
        anchors = self.anchors()
        if anchors is None:
            print("coverage data is needed: give --anchors", file=sys.stderr)
            return 1
        pages = C.discover(self.files, words or None).select("path", "content")
        rows, dropped, errors = scaffold.scaffold(pages, anchors, self.paths)
        if self.options.json:
            print(scaffold.to_json(rows, dropped, errors).first().value)
        else:
            text = [r.value for r in scaffold.to_markdown(rows, rows.select("page", "title").distinct()).orderBy("page").collect()]
            print("\n---\n\n".join(text) or "No internal fragment links with line ranges were found.")
        return 0

    def hook(self, words: list[str]) -> int:
        events = self.spark.createDataFrame([(sys.stdin.read(),)], "value string")
        event = events.select(F.regexp_replace(F.get_json_object("value", "$.tool_input.file_path"), "^" + _quoted(self.root) + "/", "").alias("p"))
        events = event.select(F.to_json(F.struct(F.struct(F.col("p").alias("file_path")).alias("tool_input"))).alias("value"))
        for r in check.hook(self.pages, self.corpus, self.paths, events, anchors=self.anchors(), mesh=self.options.anchors is not None).collect():
            print(r.value)
        return 0


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def main(argv: list[str] | None = None) -> int:
    options = parser().parse_args(argv)
    words = options.words
    spark = session(**{"spark__master": os.environ.get("INKGRAPH_MASTER", "local[*]"), "spark__ui__enabled": "false", "spark__sql__shuffle__partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    run = Run(spark, options)
    if words and words[0] in COMMANDS:
        return {"links": run.backlinks}.get(words[0], getattr(run, words[0], None))(words[1:])
    return run.search(words)


if __name__ == "__main__":
    sys.exit(main())
