import json
import subprocess

import pytest
from inkgraph.functions import markdown as md
from inkgraph.operators import check, fix, lookup, scaffold, search, sync
from inkgraph.sources import corpus as C
from inkgraph.sources import git, mesh, sinks
from pyspark.sql import functions as F


def page(title, body="", summary="About", **more):
    return "---\n" + f"title: {title}\nsummary: {summary}\n" + "".join(f"{k}: {json.dumps(v)}\n" for k, v in more.items()) + "---\n" + body


def frame(spark, pages):
    return spark.createDataFrame(list(pages.items()), "path string, content string")


def paths_of(spark, pages, *more):
    return spark.createDataFrame([(p,) for p in [*pages, *more]], "path string")


@pytest.fixture(scope="module")
def wiki(spark):
    pages = {
        "wiki/alpha.md": page("Alpha", "# Alpha\nThe zebra walks far.\nmore text here\n", aliases=["First"], tags=["Animals"]),
        "wiki/beta.md": page("Beta", "# Beta\nNothing about it.\nSee [alpha](alpha.md#alpha) and zebra there.\n", summary="zebra facts", tags=["animals", "b"]),
        "wiki/zebra.md": page("Zoo", "# Zoo\nplain\n", aliases=["alpha", "Zoo"]),
        "wiki/none.md": "no frontmatter zebra",
        "wiki/sub/deep.md": page("Zebra", "text\n", keywords=["stripes"]),
    }
    return pages, frame(spark, pages)


def test_search_tiers_and_paging(spark, wiki):
    corpus = C.corpus_of(wiki[1]).cache()
    rows = search.search(corpus, "zebra", limit=10).orderBy("position").collect()
    assert [(r.title, r.total) for r in rows][:2] == [("Zebra", 4), ("Zoo", 4)] and {r.title for r in rows} == {"Zebra", "Zoo", "Alpha", "Beta"}
    assert [r.title for r in search.search(corpus, "zebra", limit=1, offset=1).collect()] == ["Zoo"]
    assert search.search(corpus, "zebra", limit=0).count() == 0
    assert [r.title for r in search.search(corpus, "FIRST ").collect()][0] == "Alpha"
    assert [r.title for r in search.search(corpus, '"zebra walks"').collect()] == ["Alpha"]
    assert search.search(corpus, "stripes").first().title == "Zebra" and search.search(corpus, "qqq").count() == 0
    assert search.search(corpus, "!!").count() == 0 and search.search(corpus, "sub/").first().title == "Zebra"
    alpha = [r for r in rows if r.title == "Alpha"][0]
    assert alpha.snippets[0].text == "# Alpha The **zebra** walks far. more text here" and alpha.snippets[0].line == 8
    assert [r.title for r in search.suggest(corpus, "zebra unknown").collect()] and search.suggest(corpus, "zebra a1 b2 c3").count() == 0
    text = sinks.result_text(search.search(corpus, "alpha")).orderBy("position").first().value
    assert text.startswith("# Alpha\nwiki/alpha.md\nAbout")


def test_lookup(spark, wiki):
    corpus = C.corpus_of(wiki[1]).cache()
    keys = {r.key: (r.path_rel, r.kind) for r in lookup.lookup_keys(corpus).collect()}
    assert keys["alpha"] == ("wiki/alpha.md", "title") and keys["first"] == ("wiki/alpha.md", "alias") and keys["zoo"][1] == "title"
    inputs = spark.createDataFrame([("ALPHA",), ("first",), ("sub/deep.md",), ("wiki/beta.md",), ("nope",), (" alpha",)], "input string")
    got = {r.input: (r.path_rel, r.alias) for r in lookup.resolve_pages(corpus, inputs, cwd="wiki").collect()}
    assert got == {"ALPHA": ("wiki/alpha.md", None), "first": ("wiki/alpha.md", "First"), "sub/deep.md": ("wiki/sub/deep.md", None), "wiki/beta.md": ("wiki/beta.md", None)}
    assert [r.title for r in lookup.list_pages(corpus, "ANIMALS").collect()] == ["Alpha", "Beta"]
    links = C.links_of(md.links(wiki[1]))
    assert [(r.title, [s.text for s in r.snippets]) for r in lookup.backlinks(corpus, links, "wiki/alpha.md").collect()] == [("Beta", ["Nothing about it. See alpha and zebra there."])]
    assert [(r.source_title, r.line) for r in lookup.refs(corpus, links, "Alpha").collect()] == [("Beta", 8)] and lookup.refs(corpus, links, "nope").count() == 0
    codes = lookup.summaries(corpus, inputs)
    assert {r.input: r.code for r in codes.collect()}["nope"] == 1 and lookup.exit_code(codes).first().code == 1
    assert [r.href for r in lookup.completions(corpus, paths_of(spark, wiki[0]), "wiki/beta.md").collect()] == ["./alpha.md", "./beta.md", "./sub/deep.md", "./zebra.md", "./none.md"]
    hover = lookup.hover(corpus, links).collect()
    assert [(r.target_title, r.target_summary) for r in hover] == [("Alpha", "About")]
    rows = spark.createDataFrame([("x/wiki/alpha.md",), ("alpha.md",)], "p string")
    tails = {r.p: r.tail for r in lookup.suffix_path("p", paths_of(spark, wiki[0]), rows, "tail").collect()}
    assert tails == {"x/wiki/alpha.md": "wiki/alpha.md", "alpha.md": None}


def test_check(spark):
    pages = {
        "w/a.md": page("A", "# Top\n[ok](./b.md) [gone](./c.md) [bare](w/b.md) [dir](/w) [z](b.md#L0) [far](b.md#L3-L90) [back](b.md#L3-L2) [h](b.md#nope) [h2](b.md#b-head) [one](b.md#L2)\n![i](/img.png)\n`[x](y)`\n"),
        "w/b.md": page("a", "# B head\n", aliases=["q"]),
        "w/c2.md": page("C", "x", aliases=["Q", "c"]),
        "w/bad.md": page("list"),
        "w/plain.md": "nothing",
        "w/none.md": None,
    }
    df = frame(spark, pages)
    anchors = spark.createDataFrame([("m", "w/b.md", 3, 2), ("m", "w/a.md", 1, 9), ("n", "w/b.md", 0, 0)], "mesh string, path string, start_line int, end_line int")
    found = check.check(df, C.corpus_of(df), paths_of(spark, pages, "img.png"), anchors).collect()
    got = {(r.kind, r.file, r.message.split("\n")[0]) for r in found}
    assert {g for g in got if g[0] in ("runtime", "frontmatter", "collision")} == {
        ("runtime", "w/none.md", "Cannot read `w/none.md`."), ("frontmatter", "w/bad.md", "`list` is a reserved command name. Choose a different title."), ("frontmatter", "w/plain.md", "Add frontmatter with `title` and `summary`."),
        ("collision", "w/b.md", "`a` is already used by `w/a.md`."), ("collision", "w/c2.md", "`Q` is already used by `w/b.md`.")}
    broken = {(r.message, r.line) for r in found if r.kind == "broken_link"}
    assert broken == {("File `./c.md` not found.", 6), ("File `w/b.md` not found at page-relative path.\nIf you meant a repo-relative path, use `/w/b.md` instead.", 6)}
    assert {r.message for r in found if r.kind == "broken_anchor"} == {
        "Line numbers are 1-based. Replace `L0` with `L1` in `b.md`.", "Line range `L3–L90` exceeds `b.md` (6 lines).", "Line range start (`L3`) must not exceed end (`L2`) in `b.md`.", "Heading `#nope` not found in `b.md`."}
    assert {r.message.split("`")[1] for r in found if r.kind == "mesh_uncovered"} == {"w/b.md#L0-L0", "w/b.md#L3-L90", "w/b.md#L2-L2"}
    scope = spark.createDataFrame([("w/b.md",)], "path string")
    assert [r.kind for r in check.check(df, C.corpus_of(df), paths_of(spark, pages), anchors, scope=scope).collect()] == ["collision"]
    assert check.check_code(check.collisions(C.corpus_of(df))).first().code == 1
    event = spark.createDataFrame([(json.dumps({"tool_input": {"file_path": "w/b.md"}}),)], "value string")
    [message] = check.hook(df, C.corpus_of(df), paths_of(spark, pages), event, anchors=anchors).collect()
    assert "already used" in json.loads(message.value)["systemMessage"]
    assert "Error: Collision" in sync.diagnostics_text(check.collisions(C.corpus_of(df))).first().value
    assert json.loads(sinks.json_envelope(check.collisions(C.corpus_of(df)), "errors").first().value)["errors"][0]["kind"] == "collision"


def test_fix(spark):
    pages = {
        "w/a.md": page("A", "é [r](./old.md#L1) [s](/w/old.md) [bare](old.md) [x](./x.md) [amb](./amb.md) [al](b.md#Nick) [hd](b.md#old-name) [mv](b.md#L5-L6) [del](b.md#never)\n"),
        "w/b.md": page("Bee", "# Bee\n## New name\n## Other\n", aliases=["Nick"]),
        "w/new.md": page("N", "1\n2\n"),
    }
    df, paths = frame(spark, pages), paths_of(spark, pages)
    renames = spark.createDataFrame([("w/old.md", "w/new.md"), ("w/x.md", "w/y.md"), ("w/amb.md", "w/m.md"), ("w/m.md", "w/new.md")], "old string, new string")
    revisions = spark.createDataFrame([("w/b.md", 0, pages["w/b.md"]), ("w/b.md", 1, page("Bee", "# Bee\n## Old name\n## Other\n"))], "path string, ord int, content string")
    anchors = spark.createDataFrame([("m", "w/b.md", 5, 6), ("m", "w/a.md", 0, 0)], "mesh string, path string, start_line int, end_line int")
    finding = {"status": {"code": "MOVED"}, "mesh": "m", "anchored": {"path": "w/b.md", "extent": {"start": 5, "end": 6}}, "moved_to": {"path": "w/b.md", "extent": {"start": 7, "end": 8}}}
    drift = mesh.parse_drift(spark.createDataFrame([(json.dumps({"findings": [finding]}),)], "value string"))
    fixes, skipped, patched = fix.fix(df, paths, renames, revisions, anchors, drift)
    assert {(r.kind, r.old_href, r.new_href, r.confidence) for r in fixes.collect()} == {
        ("broken_link_rename", "./old.md#L1", "./new.md#L1", "high"), ("broken_link_rename", "/w/old.md", "/w/new.md", "high"), ("alias_to_canonical", "b.md#Nick", "b.md#bee", "high"),
        ("mesh_anchor_shift", "b.md#L5-L6", "b.md#L7-L8", "high"), ("heading_rename", "b.md#old-name", "b.md#new-name", "medium")}
    reasons = {r.reason for r in skipped.collect()}
    assert reasons == {"bare path; manual review", "target deleted; no successor (rename destination w/y.md missing)", "ambiguous rename: w/m.md, w/new.md", "heading `#never` not found in any revision"}
    now = {r.path: r.content for r in patched.collect()}
    assert "é [r](./new.md#L1) [s](/w/new.md) [bare](old.md) [x](./x.md) [amb](./amb.md) [al](b.md#bee) [hd](b.md#new-name) [mv](b.md#L7-L8) [del](b.md#never)\n" in now["w/a.md"]
    assert {k: v for k, v in now.items() if k != "w/a.md"} == {k: v for k, v in pages.items() if k != "w/a.md"}
    again = fix.fix(patched, paths, renames, revisions)[0]
    assert again.count() == 0
    only = fix.plan_renames(md.links(df), paths, renames, terminal_only=True)[0]
    assert "./amb.md" in {r.old_href for r in only.collect()}
    cycle = spark.createDataFrame([("a", "b"), ("b", "a")], "old string, new string")
    assert fix.rename_closure(cycle).count() == 2
    moves = spark.createDataFrame([("w/b.md", "v/b.md")], "old string, new string")
    links = check.checked_links(md.links(df)).select("path", "href", F.col("resolved").alias("target_path"), "byte_start", "byte_end")
    assert "../v/b.md#Nick" in {r.new_href for r in lookup.moved_hrefs(links, moves).collect()}


def test_scaffold(spark):
    pages = {
        "wiki/perf/a.md": page("Guide", "# Guide\n\n## 1. Parse\n[x](/src/p.rs#L1-L3) and [y](/src/q.rs#L2) again [x](/src/p.rs#L1-L3)\n\n## Parse\n[z](../../src/q.rs#L9-L9)\n\n## Known\n[k](/src/p.rs#L1-L3) [n](/src/q.rs#L4)\n\n## Gone\n[g](/src/none.rs#L1)\n"),
        "wiki/b.md": page("Second", "[Label One](/src/p.rs#L5) in a paragraph\nstill [two](deep/src/q.rs#L6)\n\n# Parse\n[x](/src/p.rs#L1)\n"),
        "wiki/bad.md": "---\ntitle:\n---\n# H\n[x](/src/p.rs#L1)\n",
    }
    anchors = mesh.parse_anchors(spark.createDataFrame([("wiki/known\twiki/perf/a.md\t13-14",), ("wiki/known\tsrc/p.rs\t1-3",), ("no meshes",), ("",)], "value string"))
    df = frame(spark, pages)
    rows, dropped, errors = scaffold.scaffold(df, anchors, paths_of(spark, pages, "src/p.rs", "src/q.rs"))
    got = {(r.page, r.slug): [f"{a.path}#L{a.start_line}-L{a.end_line}" for a in r.anchors] for r in rows.collect()}
    assert got == {
        ("wiki/perf/a.md", "wiki/perf/parse"): ["wiki/perf/a.md#L7-L8", "src/p.rs#L1-L3", "src/q.rs#L2-L2"],
        ("wiki/perf/a.md", "wiki/perf/guide/parse"): ["wiki/perf/a.md#L10-L11", "src/q.rs#L9-L9"],
        ("wiki/perf/a.md", "wiki/known"): ["src/q.rs#L4-L4"],
        ("wiki/b.md", "wiki/label-one"): ["wiki/b.md#L1-L6", "src/p.rs#L5-L5", "src/q.rs#L6-L6"],
        ("wiki/b.md", "wiki/parse"): ["wiki/b.md#L8-L9", "src/p.rs#L1-L1"],
    }
    assert [(r.slug, r.missing_path) for r in dropped.collect()] == [("wiki/perf/gone", "src/none.rs")]
    assert [(r.path, r.category) for r in errors.collect()] == [("wiki/bad.md", "empty_title")]
    out = json.loads(scaffold.to_json(rows, dropped, errors).first().value)
    assert out["schemaVersion"] == 1 and [p["path"] for p in out["pages"]] == ["wiki/b.md", "wiki/perf/a.md"] and out["droppedMeshes"][0]["missingPath"] == "src/none.rs"
    text = {r.page: r.value for r in scaffold.to_markdown(rows, rows.select("page", "title").distinct()).collect()}
    assert text["wiki/b.md"].startswith("# Second • wiki/b.md\n\n") and "git mesh add wiki/label-one \\\n  'wiki/b.md#L1-L6'" in text["wiki/b.md"]


def test_names_use_numbers_last(spark):
    rows = spark.createDataFrame([("p", i, ["Top", "Same"], "same", "d", None, "Title") for i in range(5)], "page string, ord int, heading_chain array<string>, noun string, subdir string, extends string, title string")
    held = spark.createDataFrame([("wiki/d/same-9",), ("wiki/d/title/top/same-2",)], "mesh string")
    assert [r.slug for r in scaffold.name_drafts(rows, held).orderBy("ord").collect()] == ["wiki/d/same", "wiki/d/top/same", "wiki/d/title/top/same", "wiki/d/title/top/same-3", "wiki/d/title/top/same-4"]


def test_mesh_rows(spark):
    rows = mesh.parse_anchors(spark.createDataFrame([("a\tb\tw/x.md\t0-0",)], "value string")).collect()
    assert [tuple(r) for r in rows] == [("a\tb", "w/x.md", 0, 0)]
    with pytest.raises(Exception, match="bad coverage row"):
        mesh.parse_anchors(spark.createDataFrame([("broken",)], "value string")).collect()
    assert [tuple(r) for r in mesh.parse_renames(spark.createDataFrame([("R100\ta\tb",), ("M\ta",)], "value string")).collect()] == [("a", "b")]
    log = mesh.read_log(spark.createDataFrame([('{"timestamp_ms":1,"event":"index","duration_ms":2.5,"meta":{"n":1}}',)], "value string")).first()
    assert log.event == "index" and log.duration_ms == 2.5 and log.meta == '{"n":1}'


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (root / "a.md").write_text(page("A", "one\n"))
    (root / "sub").mkdir()
    (root / "sub/b.md").write_text("old content of b\nwith lines\n")
    (root / "link.md").symlink_to("sub/b.md")
    (root / "out.md").symlink_to("/etc/hostname")
    (root / ".gitignore").write_text("ignored.md\n")
    (root / "ignored.md").write_text("x")
    run("add", "-A")
    run("commit", "-qm", "first")
    (root / "a.md").write_text(page("A", "two\n"))
    run("add", "a.md")
    (root / "a.md").write_text(page("A", "three\n"))
    (root / "new.md").write_text("untracked")
    return root, run


def test_git_snapshots(spark, repo):
    root, run = repo
    git.register(spark)
    read = lambda s: {r.path: r.content for r in spark.read.format("git_snapshot").option("repo", str(root)).option("snapshot", s).load().collect()}
    head, index, tree = read("head"), read("index"), read("worktree")
    assert ["one" in head["a.md"], "two" in index["a.md"], "three" in tree["a.md"]] == [True] * 3
    assert "new.md" in tree and "new.md" not in index and "ignored.md" not in tree
    assert all(s["link.md"] == s["sub/b.md"] and s["out.md"] is None for s in (head, index, tree))
    assert len(git.revision(str(root))) == 40
    run("mv", "sub/b.md", "sub/c.md")
    assert git.renames(str(root), staged=True) == [("sub/b.md", "sub/c.md")]
    assert [(p, o) for p, o, _ in git.history(str(root), "a.md")] == [("a.md", 0)]


def test_read_pages_and_discovery(spark, tmp_path):
    for name in ("a.md", "x/tests/fixtures/b.md", "tests/fixtures/c.md", "d.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("é " + name)
    pages = C.read_pages(spark, str(tmp_path))
    assert {r.path: r.content for r in pages.collect()}["a.md"] == "é a.md"
    assert {r.path for r in C.discover(pages).collect()} == {"a.md", "tests/fixtures/c.md"}
    assert {r.path for r in C.discover(pages, ["x/**/*.md", "d.txt"]).collect()} == {"x/tests/fixtures/b.md"}


def test_sync(spark):
    old = spark.createDataFrame([("a", 1, 5, "h1"), ("b", 1, 5, "h2"), ("c", 1, 5, "h3"), ("d", 1, 5, "h4")], "path string, mtime_ns long, size_bytes long, content_hash string")
    new = spark.createDataFrame([("a", 1, 5, "h1"), ("b", 2, 5, "h2"), ("c", 2, 6, "hX"), ("e", 1, 5, "h4")], "path string, mtime_ns long, size_bytes long, content_hash string")
    assert {r.path: r.status for r in sync.change_set(old, new).collect()} == {"a": "unchanged", "b": "touched", "c": "changed", "d": "deleted", "e": "added"}
    assert {r.path: r.status for r in sync.hash_changes(old, new).collect()} == {"c": "changed", "d": "deleted", "e": "added"}
    assert [tuple(r) for r in sync.renamed(old, new).collect()] == [("d", "e")]
    state = spark.createDataFrame([("r1", "head", sync.STRATEGY)], "revision string, source string, strategy int")
    assert not sync.needs_full_scan(state, "r1", "head") and sync.needs_full_scan(state, "r2", "head") and sync.needs_full_scan(state.limit(0), "r1", "head")


def test_stream(spark, tmp_path):
    from inkgraph.streaming import sync as stream

    def step(*rows):
        spark.createDataFrame(list(rows), stream.SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream.start(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        return {r.path: r.content for r in stream.current(spark, f"{tmp_path}/out").where("not deleted").collect()}

    assert step(("a", "1", 1, False), ("a", "2", 2, False), ("b", "x", 1, None)) == {"a": "2", "b": "x"}
    assert step(("a", "late", 1, False), ("b", "y", 3, False), ("c", "z", 1, False)) == {"a": "2", "b": "y", "c": "z"}
    assert step(("b", None, 4, True)) == {"a": "2", "c": "z"}


def test_quick_pick_and_render(spark, wiki):
    from inkgraph.functions import render

    corpus = C.corpus_of(wiki[1])
    assert [r.title for r in search.quick_pick(corpus, " ").collect()] == ["Alpha", "Beta", "Zebra", "Zoo"]
    assert search.quick_pick(corpus, "first").first().title == "Alpha"
    text = page("T", '# A_b C!\n<b> [x](y.md "t") `c<` **d**\n\n- one\n- two\n```mermaid\ngraph\n```\n```py\nx\n```\n![i](p.png) http://z.example/q.\n')
    out = spark.createDataFrame([(text,), (None,)], "c string").select(render.render_html("c").alias("h")).collect()
    assert '<h1 id="a_b-c" data-line="5">A_b C!</h1>' in out[0].h and '&lt;b&gt; <a href="y.md">x</a> <code>c&lt;</code> <strong>d</strong>' in out[0].h
    assert '<pre class="mermaid" data-line="10">graph</pre>' in out[0].h and 'class="language-py"' in out[0].h and "<li data-line=\"8\">one</li>" in out[0].h
    assert '<a href="http://z.example/q">http://z.example/q</a>.' in out[0].h and out[1].h is None
    links = render.editor_links(spark.createDataFrame([("p", text)], "path string, content string")).collect()
    assert [(r.text, r.href) for r in links] == [("x", "y.md")]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from inkgraph import __main__ as cli

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.md").write_text(page("Alpha", "# Alpha\nwords about zebras here\n[b](b.md) [gone](./old.md)\n", aliases=["First"]))
    (tmp_path / "b.md").write_text(page("Beta", "# Beta\n[a](a.md#alpha)\n"))
    (tmp_path / "old.md").write_text("long enough text that git can see a rename of it\n" * 5)
    run("add", "-A")
    run("commit", "-qm", "one")
    run("mv", "old.md", "new.md")
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(cli, "session", lambda **_: spark)
    call = lambda *a: (cli.main(list(a)), capsys.readouterr().out)
    assert "Alpha" in call("zebras")[1] and json.loads(call("zebras", "--json")[1])[0]["file"] == "a.md"
    assert [x["title"] for x in json.loads(call("list", "--json")[1])] == ["Alpha", "Beta"]
    assert call("summary", "first")[0] == 0 and call("summary", "nope")[0] == 1
    assert "b.md:6" in call("refs", "Alpha")[1] and "Beta" in call("links", "Alpha")[1]
    code, out = call("check", "--json", "--no-mesh")
    assert code == 1 and [e["kind"] for e in json.loads(out)["errors"]] == ["broken_link"]
    call("check", "--fix")
    assert "[gone](./new.md)" in (tmp_path / "a.md").read_text() and call("check", "--no-mesh")[0] == 0
    (tmp_path / "anchors").write_text("no meshes\n")
    assert json.loads(call("scaffold", "--json", "--anchors", str(tmp_path / "anchors"))[1])["pages"] == []


def test_renamed_leaves_out_ambiguous_content(spark):
    old = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "i"), ("k", None)], "path string, content_hash string")
    new = spark.createDataFrame([("x", "h"), ("y", "h"), ("z", "i"), ("k", None)], "path string, content_hash string")
    assert [tuple(r) for r in sync.renamed(old, new).collect()] == [("c", "z")]


def test_a_blank_line_takes_no_place_among_snippets(spark):
    corpus = spark.createDataFrame([(f"p{n}.md", "Same", ["", "one", "two", "three"][n]) for n in range(4)], "path_rel string, title string, content string")
    links = corpus.select(F.col("path_rel").alias("source_file"), F.lit(1).alias("source_line"), F.lit("t.md").alias("target_path"))
    assert [(r.path_rel, [s.text for s in r.snippets]) for r in lookup.backlinks(corpus, links, "t.md").collect()] == [("p0.md", ["one", "two", "three"])]


def test_slugs_are_given_as_if_one_after_the_other(spark):
    """Against the sequential rule, with names that are numbers of other names, held ones among them; no group has all drafts of a word."""
    import random

    rng = random.Random(7)
    pick = lambda: rng.choice(["x", "x-2", "x-3", "x-2-2", "y"])
    drafts = [(f"p{rng.randrange(30):02}", i, [pick() for _ in range(rng.randrange(3))], pick(), rng.choice(["", "x", "y"]), rng.choice([None, "T", "x-2"]), None) for i in range(150)]
    meshes = {"wiki/x-4", "wiki/t/x-3", "wiki/y", "wiki/x/x-2-3"}
    taken, want = set(meshes), {}
    for page, ord_, chain, noun, subdir, title, _ in sorted(drafts, key=lambda d: d[:2]):
        chain, options = [h for h in chain if h != noun], []
        options = [chain[len(chain) - n :] for n in range(len(chain) + 1)] + ([[title.lower(), *chain]] if title and title.lower() != noun else [])
        names = ["/".join([*dict.fromkeys(["wiki", *filter(None, [subdir]), *q]), noun]) for q in options]
        numbers = (f"{names[-1]}-{n}" for n in range(2, 1000))
        want[page, ord_] = next(n for n in (*names, *numbers) if n not in taken)
        taken.add(want[page, ord_])
    rows = spark.createDataFrame(drafts, "page string, ord int, heading_chain array<string>, noun string, subdir string, title string, extends string")
    named = scaffold.name_drafts(rows, spark.createDataFrame([(m,) for m in meshes], "mesh string"))
    assert {(r.page, r.ord): r.slug for r in named.collect()} == want
    assert "FlatMapCoGroupsInPandas" not in named._jdf.queryExecution().toString()


def test_small_files_are_read_in_few_tasks(spark, tmp_path):
    for i in range(600):
        (tmp_path / f"{i}.md").write_text(f"page {i}")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4194304")  # one small file fills a partition
    try:
        pages = C.read_pages(spark, str(tmp_path))
        assert pages.rdd.getNumPartitions() <= 24
        assert {(r["path"], r["content"]) for r in pages.collect()} == {(f"{i}.md", f"page {i}") for i in range(600)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
