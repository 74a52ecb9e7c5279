"""The stored index against the operators over the corpus itself, and what its updates write."""

import random
import uuid
from pathlib import Path

import pyarrow as pa
import pytest
from inkgraph.functions.query import parse_query
from inkgraph.operators import index, search
from inkgraph.sources.tables import shared_dir

SCHEMA = "path_rel string, title string, summary string, aliases array<string>, tags array<string>, keywords array<string>, body string, content string"
WORDS = "the ring of fire of the sea and the wind over élan vital Zürich snake_case x1".split()


def page(rng, n, tag="a"):
    words = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    body = words(rng.randrange(0, 30)) + "\nlast " + tag
    return (f"wiki/{tag}/Page-{n}.md", words(3), words(4), [f"p{n}", words(1)], [tag], None if n % 3 else ["key"], body, body)


def corpus(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def folder(spark):
    return f"{shared_dir(spark)}/test-index-{uuid.uuid4().hex}"


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path.removeprefix("file:")).rglob("*") if p.is_file()}


def rows(df, *columns):
    return sorted(map(repr, (tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())))


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(4)
    return [page(rng, n, "ab"[n % 2]) for n in range(40)]


@pytest.fixture(scope="module")
def built(spark, pages):
    return index.update(spark, folder(spark), corpus(spark, pages))


@pytest.mark.parametrize("text", ["fire", "of the sea", '"of the"', '"the ring of" wind', '"of fire of"', "élan zürich", "nothing", "p7", "page 3", "b 1", "--", "", '"the the"'])
def test_search_as_over_the_corpus(spark, pages, built, text):
    over = corpus(spark, pages)
    query = parse_query(text)
    if query.searchable:
        assert rows(index.bm25(built, query), "path_rel", "score") == rows(search.bm25(over, query), "path_rel", "score")
    assert rows(index.tiers(built, text), "title", "path_rel", "tier", "rank") == rows(search.tiers(over, text), "title", "path_rel", "tier", "rank")
    want = rows(search.search(over, text, 4, 2), "position", "title", "file", "summary", "snippets", "total")
    assert rows(index.search_page(built, text, 4, 2), "position", "title", "file", "summary", "snippets", "total") == want
    assert rows(index.suggest(built, text), "file", "score") == rows(search.suggest(over, text), "file", "score")


def test_tokens_of_the_root_hold_everywhere(spark, pages, built):
    over = corpus(spark, pages)
    for text in ("repo", "repo b", "re 1"):
        query = parse_query(text)
        assert rows(index.path_tier(built, query, "/My/Repo"), "path_rel") == rows(search.path_tier(over, query, "/My/Repo".lower()), "path_rel")


def test_postings_are_read_from_their_buckets(spark, built):
    rows_ = built.listed("postings", "term", ["fire"]).select("doc", "tf", "dl")
    plan = rows_._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "EqualTo(term,fire)" in plan or "In(term, [fire])" in plan
    assert "places" not in plan.split("ReadSchema")[1]


def test_updates_equal_a_rebuild(spark):
    rng = random.Random(9)
    path, now = folder(spark), {}
    for step in range(7):
        for n in rng.sample(range(30), 6):  # new pages, and other texts of known ones
            p = page(rng, n)
            now[p[0]] = p
        gone = rng.sample(sorted(now), 2) if step else []
        for p in gone:
            now.pop(p)
        if step % 2:
            ix = index.update(spark, path, corpus(spark, list(now.values())), whole=True)
        else:
            ix = index.update(spark, path, corpus(spark, list(now.values())), deleted=corpus(spark, [(p, *[None] * 7) for p in gone]))
    fresh = index.update(spark, folder(spark), corpus(spark, list(now.values())))
    columns = ["path_rel", "field", "terms", "words", "placed"]
    assert rows(index.contents(ix), *columns) == rows(index.contents(fresh), *columns)
    assert ix.count == fresh.count == len(now) and all(ix.mean_length(f) == fresh.mean_length(f) for f in index.FIELDS)
    assert len(ix.segments) <= 2 * index.MERGE
    for text in ("fire wind", "page 2"):
        assert rows(index.tiers(ix, text), "title", "tier", "rank") == rows(index.tiers(fresh, text), "title", "tier", "rank")
    one = index.compact(ix, all_=True)
    assert len(one.segments) == 1 and not one.segments[0]["dead_docs"]
    assert rows(index.contents(one), *columns) == rows(index.contents(fresh), *columns)
    assert rows(index.contents(index.open_index(spark, path, ix.version)), *columns) == rows(index.contents(fresh), *columns)  # an older version
    index.vacuum(one)
    assert index.open_index(spark, path, ix.version) is None
    assert rows(index.contents(index.open_index(spark, path)), *columns) == rows(index.contents(fresh), *columns)


def test_an_unchanged_corpus_writes_nothing(spark, pages):
    path = folder(spark)
    first = index.update(spark, path, corpus(spark, pages))
    before = files(path)
    again = index.update(spark, path, corpus(spark, pages), whole=True)
    assert again.version == first.version and files(path) == before
    one = list(pages[5])
    one[2] = "another summary"
    third = index.update(spark, path, corpus(spark, [tuple(one)]))
    assert third.version == first.version + 1 and {f: t for f, t in files(path).items() if f in before} == before
    assert third.segments[-1]["docs"] == 1 and third.segments[0]["dead_docs"] == 1


def test_empty_corpora(spark):
    path = folder(spark)
    ix = index.update(spark, path, corpus(spark, []))
    assert ix.count == 0 and index.tiers(ix, "fire").count() == 0 and index.search_page(ix, "fire").count() == 0
    ix = index.update(spark, path, corpus(spark, [page(random.Random(1), 1)]))
    assert ix.count == 1
    ix = index.update(spark, path, corpus(spark, []), whole=True)
    assert ix.count == 0 and not ix.segments and index.bm25(ix, parse_query("the")).count() == 0


def test_stream_of_versions(spark):
    from inkgraph.streaming import sync

    top = folder(spark)
    text = lambda title, more="": f"---\ntitle: {title}\nsummary: s\n---\n{more}"
    batches = [
        [("a.md", text("A", "fire"), 1, False), ("b.md", text("B", "wind"), 1, False), ("a.md", text("A", "old fire old"), 0, False)],
        [("b.md", "no member any more", 2, False), ("c.md", text("C", "fire and wind"), 2, None), ("x.md", None, 2, True)],
        [("a.md", None, 3, True), ("c.md", text("C", "wind"), 3, False)],
    ]
    seen = []
    for i, rows_ in enumerate(batches):
        spark.createDataFrame(rows_, sync.SCHEMA).coalesce(1).write.json(f"{top}/in/{i}")
        for _ in range(2):
            sync.start_indexed(spark, f"{top}/in/*", f"{top}/index", f"{top}/check").awaitTermination()
        ix = index.open_index(spark, f"{top}/index")
        seen.append([sorted(r["path_rel"] for r in index.bm25(ix, parse_query(w)).collect()) for w in ("fire", "wind", "old")])
    assert seen == [[["a.md"], ["b.md"], []], [["a.md", "c.md"], ["c.md"], []], [[], ["c.md"], []]]


def test_the_second_of_two_updates_fails(spark, pages):
    path = folder(spark)
    base = index.update(spark, path, corpus(spark, pages[:3]))
    index.update(spark, path, corpus(spark, pages[:5]))
    with pytest.raises(RuntimeError):
        index._publish(index.Index(spark, path, base.version + 1, base.buckets, base.segments))
    assert index.open_index(spark, path).count == 5


def test_words_are_shuffled_and_stored_as_packs(spark, built):
    stored = spark.read.schema(index.PACKS).parquet(*[f"{built.path}/{s['name']}/postings" for s in built.segments])
    spelled = built.read("postings")
    assert stored.agg({"n": "sum"}).first()[0] == spelled.count() > 2 * stored.count()  # a row for a word of a field in many pages


def test_packs_of_pages_of_several_segments():
    far = 1 << index.PAGE_BITS
    of = [("fire", "body", 3, [0, 9]), ("fire", "body", 70_000, [4]), ("fire", "body", far + 1, [2]), ("fire", "title", 3, [1]), ("sea", "body", far + 1, [0, 1, 99_000])]
    rows_ = [{"term": t, "field": f, "doc": d, "tf": len(p), "dl": 100_000 if d > far else 10, "places": p, "bucket": 1} for t, f, d, p in of]
    types = {"term": pa.string(), "field": pa.string(), "doc": pa.int64(), "tf": pa.int32(), "dl": pa.int32(), "places": pa.list_(pa.int32()), "bucket": pa.int32()}
    batch = pa.RecordBatch.from_pylist(rows_, pa.schema(list(types.items())))
    packs = list(index._packed(iter([batch])))
    assert packs[0].column("n").to_pylist() == [2, 1, 1, 1]
    assert [r for b in index._spelled(iter(packs)) for r in b.to_pylist()] == rows_
