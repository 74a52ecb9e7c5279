import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from inkgraph.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    queries = []
    for name, text in items:
        w = words(text)
        n = min(window, len(w))
        queries += [(str(name), tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n]
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for name, q in queries:
            for i in range(len(w) - len(q) + 1):
                if tuple(w[i : i + len(q)]) == q:
                    hit |= set(range(i, i + len(q)))
                    found.add(name)
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(map(repr, out))


def found(df):
    return sorted(repr((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in df.collect())


@pytest.fixture(scope="module")
def data():
    rng = random.Random(6)
    vocab = ["the", "of", "a", "é", "ü9", "X", "y-z", "Of,"] + [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randrange(1, 40))) for i in range(25)] + [(3, text(12)), (40, ""), (41, None), (42, "...")]
    docs = []
    for i in range(120):
        parts = [text(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(max(1, len(w)))
            parts += [" ".join(w[a : a + rng.randrange(5, 30)]).upper(), text(rng.randrange(20))]
        docs.append((i, "\n".join(parts)))
    return docs + [(200, None), (201, ""), (None, items[0][1]), (0, docs[0][1]), (202, " the" * 5000)], items


def test_is_brute_force(spark, data):
    docs, items = data
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    want = brute(docs, items)
    assert found(d.decontaminate(df, bench)) == want
    assert found(d.decontaminate(df, bench, broadcast_bytes=0)) == want
    assert found(d.decontaminate(df, bench, window=5)) == brute(docs, items, 5)


def test_empty(spark, data):
    docs, items = data
    none = spark.createDataFrame([], "doc_id long, text string, item_id long")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert d.decontaminate(none, none).count() == 0
    assert d.decontaminate(df, none).where("contaminated").count() == 0


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma of the")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "gamma x x alpha x beta of x the"), (2, "alpha " + "x " * 50 + "beta gamma of the"), (3, "alpha beta")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.near_items for r in d.decontaminate(docs, items, near_terms=5).collect()}
    assert got == {1: ["1"], 2: [], 3: []}


def test_proximity_is_of_the_whole_index(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta nowhere"), (2, "sigma tau"), (3, "omega nowhere")], "item_id long, text string")
    rows = [(1, "x beta x gamma alpha"), (2, "delta delta"), (3, "delta beta"), (4, "tau x sigma"), (5, "delta"), (6, "sigma"), (7, "omega")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 2, 7):
        got = {r.doc_id: r.near_items for r in d.decontaminate(docs.repartitionByRange(parts, "doc_id"), items, window=4).collect()}
        assert got == {1: ["1"], 4: ["2"], 2: [], 3: [], 5: [], 6: [], 7: []}
        joined = d.decontaminate(docs.repartitionByRange(parts, "doc_id"), items, window=4, broadcast_bytes=0)
        assert {r.doc_id: r.near_items for r in joined.collect()} == got


def test_words_of_equal_polynomial_hashes_are_different(spark):
    from .colliding import PAIRS

    for a, b in PAIRS:
        docs = spark.createDataFrame([(1, a), (2, b), (3, "x " + a)], "doc_id long, text string")
        items = spark.createDataFrame([(1, a)], "item_id long, text string")
        assert {r.doc_id: r.contaminated for r in d.decontaminate(docs, items).collect()} == {1: True, 2: False, 3: True}


def test_many_items_of_common_terms_are_searched_at_once():
    """Twice the items take about twice the time, as all windows of a block are intersected together."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(2000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    key = b"k"
    terms, number, _ = d.terms_of(pa.array([text(40_000)]), key)
    order = np.argsort(number, kind="stable")
    starts = np.searchsorted(number[order], np.arange(len(terms) + 1))
    p = d.Postings(terms.tobytes(), d.pack_deltas(starts), d.pack_deltas(order), np.array([40_000]))
    took = []
    for n in (1000, 2000):
        rows = []
        for i in range(n):
            own, words, _ = d.terms_of(pa.array([text(30)]), key)
            counts = np.where(d.look_up(p.terms, own) >= 0, 1, 0)
            rows += [r[1:] for r in d._queries_of(str(i), own, words.astype(np.int32), counts, 10, 3) if not r[0]]
        queries = d._listed(rows, 10)
        began = time.perf_counter()
        assert list(d.search(p, queries, d._listed([], 3), 30)) == []
        took.append(time.perf_counter() - began)
    assert took[1] < 5 * took[0] + 0.2


def test_a_query_returns_near_items(spark, tmp_path):
    from inkgraph.llm.queries import op4_near_items

    spark.createDataFrame([(1, "x beta x gamma alpha")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.near_items for r in op4_near_items(spark, str(tmp_path)).collect()] == [["1"]]
