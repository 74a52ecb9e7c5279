import random

import pytest
from inkgraph.functions import frontmatter as fm
from inkgraph.functions import markdown as md
from inkgraph.functions import text as T
from inkgraph.functions.query import parse_query
from inkgraph.sources.corpus import glob_regex
from pyspark.sql import functions as F


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", f(F.col("x")).alias("y"))
    return [r.y for r in rows.orderBy("i").collect()]


def test_scalars(spark):
    assert column(spark, ["Hello World", "a_b-C", "--x  y!", "Ünï 9", "日本 語"], T.github_slug) == ["hello-world", "ab-c", "x--y", "ünï-9", "日本-語"]
    assert column(spark, ["1. First Thing", "2) x", "3 x", "Hé--llo!!", "***"], T.kebab) == ["first-thing", "x", "3-x", "h-llo", ""]
    assert column(spark, ["", "a", "a\n", "a\nb", "\n\n"], T.line_count) == [0, 1, 1, 2, 2]
    assert column(spark, ["", "a\r\nb", "a\n"], T.lines) == [[], ["a", "b"], ["a"]]
    assert column(spark, ["a/./b/../c", "/x//y", "../../z", ""], T.normal_path) == ["a/c", "x/y", "z", ""]
    assert column(spark, ["./a", "../a", "a/b", "/a", "..a"], T.is_bare) == [False, False, True, False, True]
    assert column(spark, ["see [a](b) and [](c)"], T.strip_links) == ["see a and [](c)"]
    assert column(spark, [" \t a b  \n"], T.strip) == ["a b"]
    assert column(spark, ["broken_link"], T.title_case) == ["Broken Link"]
    assert column(spark, ["It's A-b_c 9"], T.terms) == [["it", "s", "a", "b", "c", "9"]]


@pytest.mark.parametrize(("target", "page", "want"), [("w/a.md", "w/b.md", "./a.md"), ("a.md", "w/x/b.md", "../../a.md"), ("w/x/a.md", "w/b.md", "./x/a.md"), ("w/y/a.md", "w/x/b.md", "../y/a.md"), ("a.md", "b.md", "./a.md"), ("w/x", "w/x/b.md", "../x")])
def test_relative_href(spark, target, page, want):
    assert spark.range(1).select(T.relative_href(F.lit(target), F.lit(page))).first()[0] == want


def test_query():
    q = parse_query('  "Of The" end  "open  x')
    assert q.phrases == ("of the",) and q.terms == ("end", "open", "x") and q.tokens == ("of", "the", "end", "open", "x")
    assert parse_query("!!").tokens == ("!!",) and not parse_query("!!").searchable and parse_query(" ").tokens == ()


def test_frontmatter(spark):
    page = lambda *lines: "---\n" + "\n".join(lines) + "\n---\nbody"
    cases = [
        (page("title: A", "summary: B", "tags: [x, 'y z']", "aliases:", "  - q"), None),
        (page("summary: B"), "missing_title"), (page("title: ''", "summary: B"), "empty_title"), (page("title: 42", "summary: B"), "invalid_title"),
        (page("title: LIST", "summary: B"), "reserved_title"), (page("title: A", "aliases: x", "summary: B"), "invalid_aliases"), (page("title: A", "tags: [1]", "summary: B"), "invalid_tags"),
        (page("title: A", "keywords: ['']", "summary: B"), "invalid_keywords"), (page("title: A"), "missing_summary"), (page("title: A", "summary: ''"), "empty_summary"),
        (page("title: A", "summary: [x]"), "invalid_summary"), (page("title: [A"), "yaml"), (page("title: 2020-01-01", "summary: yes"), None),
        ("\n\n" + page("title: A", "summary: B"), None), (page("title: A", "summary: B").replace("\n", "\r\n"), None), (page("title: A", "aliases: [list]", "summary: B"), None),
    ]
    got = column(spark, [c for c, _ in cases], fm.parse_frontmatter)
    assert [g.error for g in got] == [e for _, e in cases]
    assert got[0].asDict() == {"title": "A", "summary": "B", "tags": ["x", "y z"], "aliases": ["q"], "keywords": [], "error": None, "message": None}
    assert got[4].message == "`LIST` is a reserved command name. Choose a different title."
    assert column(spark, ["no block", "---\ntitle: A\n", "", None, "x\n---\na: b\n---\n"], fm.parse_frontmatter) == [None] * 5
    assert column(spark, ["---\na: b\n---\nbody\n", "---\r\na: b\r\n---\r\nx", "plain"], fm.markdown_body) == ["body\n", "---\r\na: b\r\n---\r\nx", "plain"]
    assert column(spark, ["---\ntitle:\n---\n", "---\ntitle: 'x'\n---\n", "---\nopen", "plain", "---\nname: x\n---\n", None], fm.proposal_error) == ["empty_title", None, "malformed", None, None, "unreadable"]


def scrub_by_hand(text):
    """The rules of what is no content, byte by byte."""
    raw, out, i = text.encode(), bytearray(text.encode()), 0

    def blank(a, b):
        for k in range(a, b):
            if out[k] != 10:
                out[k] = 32

    while i < len(raw):
        if raw[i : i + 4] == b"<!--":
            end = raw.find(b"-->", i + 2)
            end = len(raw) if end < 0 else end + 3
            blank(i, end)
            i = end
        elif raw[i : i + 1] in (b"`", b"~"):
            c, n = raw[i], 0
            while i + n < len(raw) and raw[i + n] == c:
                n += 1
            if n >= 3 and (i == 0 or raw[i - 1] == 10):
                at, end = raw.find(b"\n", i), len(raw)
                while at >= 0:
                    stop = raw.find(b"\n", at + 1)
                    line = raw[at + 1 : len(raw) if stop < 0 else stop]
                    if line.startswith(bytes([c]) * n) and not line[n:].strip(b" "):
                        end = len(raw) if stop < 0 else stop + 1
                        break
                    at = stop
                blank(i, end)
                i = end
            elif c == 96 and n <= 2:
                end = raw.find(bytes([c]) * n, i + n)
                if end < 0:
                    i += 1
                else:
                    blank(i + n, end)
                    i = end + n
            else:
                i += n
        else:
            i += 1
    return out.decode()


def test_scrub(spark):
    rng = random.Random(20)
    texts = ["".join(rng.choice(["`", "``", "```", "~~~", "\n", " ", "a", "é", "<!--", "-->", "x"]) for _ in range(rng.randrange(14))) for _ in range(3000)]
    got = column(spark, texts, md.scrub)
    assert [(t, g) for t, g in zip(texts, got, strict=True) if g != scrub_by_hand(t)] == []


def test_links(spark):
    text = "é [a](b.md#L2-L7&x) ![i](/p.png)\n`[no](x)` [m](mailto:x@y) [u](http://z/a#b)\n```\n[no](y)\n```\n[t `c`](../q.md#Some-Head) [e](#L5) [b](<!-- [x](y) -->z)"
    rows = [r.asDict() for r in md.links(spark.createDataFrame([("w/p.md", text)], "path string, content string")).orderBy("ordinal").collect()]
    assert [(r["href"], r["kind"], r["target"], r["start_line"], r["end_line"], r["source_line"]) for r in rows] == [
        ("b.md#L2-L7&x", "internal", "b.md", 2, 7, 1), ("/p.png", "internal", "/p.png", None, None, 1), ("mailto:x@y", "external", "mailto:x@y", None, None, 2),
        ("http://z/a#b", "external", "http://z/a", None, None, 2), ("../q.md#Some-Head", "internal", "../q.md", None, None, 6), ("#L5", "internal", "", 5, None, 6), ("<!-- [x](y) -->z", "internal", "<!-- [x](y) -->z", None, None, 6)]
    assert rows[4]["text"] == "t `c`"
    raw = text.encode()
    assert all(raw[r["byte_start"] : r["byte_end"]].decode() == r["href"] for r in rows)


def test_line_range(spark):
    cases = {"L10": (10, None), "l10-L20": (10, 20), "L10-20": (10, 20), "L2-L7&sha": (2, 7), "L1L2": (None, None), "L10-20-30": (10, None), "Login": (None, None), "head": (None, None), "L99999999999": (None, None), "": (None, None)}
    start, end = md.line_range("x")
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", start.alias("s"), end.alias("e")).collect()
    assert {r.x: (r.s, r.e) for r in rows} == cases


def test_headings_and_positions(spark):
    text = "# A\n## B\n### C\n## B\n#no\n####### seven\n```\n# In fence\n```\n# A\n## D_e f!"
    found = md.headings(spark.createDataFrame([("p", text)], "path string, content string"))
    rows = md.heading_positions(found).orderBy("line").collect()
    assert [(r.line, r.level, r.slug, r.parent_slug, r.sibling_index) for r in rows] == [(1, 1, "a", "", 0), (2, 2, "b", "a", 0), (3, 3, "c", "b", 0), (4, 2, "b-1", "a", 1), (8, 1, "in-fence", "", 1), (10, 1, "a-1", "", 2), (11, 2, "de-f", "a-1", 0)]


def test_sections(spark):
    text = "intro [x](y)\nmore\n\nnext para\n# One\na\n\n  ## Two `c` *d*\nb\n```\n# fenced\n```\n\n\n# Three\nend\n"
    rows = {r.line: r for r in md.sections(md.outline_lines(spark.createDataFrame([("p", text)], "path string, content string"))).collect()}
    at = lambda n: (list(rows[n].heading_chain), rows[n].section_heading, rows[n].section_start, rows[n].section_end)
    assert at(1) == ([], "", 1, 2) and at(2) == ([], "", 1, 2) and at(4) == ([], "", 4, 4)
    assert at(6) == (["One"], "One", 5, 6) and at(9) == (["One", "Two c d"], "Two c d", 8, 12) and at(16) == (["Three"], "Three", 15, 16)


def test_globs():
    import re

    hit = lambda g, p: bool(re.match(glob_regex(g), p))
    assert hit("wiki/*.md", "wiki/a/b.md") and hit("**/*.md", "a.md") and hit("**/x.md", "a/b/x.md") and not hit("wiki/*.md", "wiki/a.txt")
    assert hit("w/{a,b}.md", "w/b.md") and hit("w/[!a].md", "w/b.md") and not hit("w/[!a].md", "w/a.md") and hit("a?.md", "ab.md") and not hit("a.md", "aXmd")
