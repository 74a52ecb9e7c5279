"""After every change the incremental findings are those of a full check."""

import random

import pytest
from inkgraph.operators import check, recheck
from inkgraph.sources import corpus as C
from inkgraph.sources.tables import written


def page(rng, names):
    title = rng.choice(["One", "Two", "Three", "Four"])
    head = rng.choice([f"---\ntitle: {title}\nsummary: s\naliases: [{rng.choice('xyz')}]\n---\n", f"---\ntitle: {title}\n---\n", ""])
    lines = []
    for _ in range(rng.randrange(5)):
        to = rng.choice([*names, "d1", "d1/e", "nothing.md", "../d2/n3.md", "n3.md"])
        lines.append(f"[x]({'/' if rng.random() < 0.6 else ''}{to}{rng.choice(['', '#L1-L2', '#L3', '#L0', '#part', '#part-1', '#other'])})")
        lines.append(rng.choice(["## Part", "# Other", "text"]))
    return head + "\n".join(lines)


def frame(spark, d):
    return spark.createDataFrame(list(d.items()), "path string, content string")


def plain(df):
    return sorted(map(tuple, df.select("kind", "file", "line", "message").collect()), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_as_a_full_check(spark, seed):
    rng = random.Random(seed)
    names = [f"d{i % 3}/{'e/' * (i % 2)}n{i}.md" for i in range(8)]
    state = {n: page(rng, names) for n in names[:6]}
    mesh = lambda: spark.createDataFrame([(rng.choice("mk"), rng.choice(names), *rng.choice([(0, 0), (1, 2), (3, 3)])) for _ in range(6)], "mesh string, path string, start_line int, end_line int")
    of = lambda d: recheck.facts(frame(spark, d), C.corpus_of(frame(spark, d)), frame(spark, d).select("path"))
    anchors, facts = mesh(), of(state)
    found = written(recheck.findings(facts, anchors), "test-findings")
    for step in range(3):
        came = {n: rng.choice([page(rng, names), page(rng, names), None]) for n in rng.sample(names, 2)}
        gone = rng.sample(sorted(set(state) - set(came)), 1)
        state = {k: v for k, v in (state | came).items() if k not in gone}
        old_anchors, anchors = anchors, anchors if step == 0 else mesh()
        facts, after = recheck.recheck(facts, found, of(came), spark.createDataFrame([(g,) for g in gone], "path string"), anchors, old_anchors)
        found = written(after, "test-findings")
        pages = frame(spark, state)
        assert plain(found) == plain(check.check(pages, C.corpus_of(pages), pages.select("path"), anchors))


def test_only_pages_near_the_change_are_checked(spark):
    pages = {f"p{i}.md": f"[next](/p{i + 1}.md#L1)" for i in range(20)}
    facts = recheck.facts(frame(spark, pages), C.corpus_of(frame(spark, {})), frame(spark, pages).select("path"))
    new = frame(spark, {"p7.md": ""})
    changed = recheck.facts(new, C.corpus_of(frame(spark, {})), new.select("path"))
    none = spark.createDataFrame([], "path string")
    assert sorted(r["path"] for r in recheck.affected(facts, changed, none).collect()) == ["p6.md", "p7.md"]
    assert recheck.affected(facts, recheck.facts(frame(spark, {}), C.corpus_of(frame(spark, {})), none), none).count() == 0
