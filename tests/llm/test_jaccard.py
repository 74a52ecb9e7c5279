import random
import re

import pytest
from inkgraph.llm import jaccard as j
from inkgraph.llm import tiles
from inkgraph.llm.components import components
from pyspark.sql import functions as F

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs, percent=75, tie=None):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(docs)):
        for y in range(x):
            tied = tie and docs[x][0] is not None and docs[y][0] is not None and tie(docs[x][0]) == tie(docs[y][0])
            if sets[x] and sets[y] and tied:
                parent[find(x)] = find(y)
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                parent[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(docs):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return sorted(repr((i, len(sets[x]), least.get(find(x), i))) for x, (i, _) in enumerate(docs))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(400)] + ["The", "of", "été"]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    out = []
    shared = text(60)
    for group in range(25):
        base = text(rng.choice([3, 6, 20, 60, 150]))
        for _ in range(rng.choice([1, 2, 5, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.choice([0, 1])] = text(rng.choice([0, 1]))
            if group % 5 == 0:
                w = shared + w
            out.append(" ".join(w).replace("w1 ", "W1\n"))
    rng.shuffle(out)
    out += ["", None, " \n", "a", "A", "a b", "the " * 3000, "the " * 10]
    return [(i * 3, t) for i, t in enumerate(out)] + [(None, out[0]), (0, out[0])]


@pytest.mark.parametrize("fragments", [1, 7])
def test_is_brute_force(spark, docs, fragments):
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, node string").repartition(3)
    got = j.join_components(df, fragments=fragments).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(docs)


@pytest.mark.parametrize("size", [1, 3])
def test_tied_rows_are_linked_whatever_their_texts(spark, docs, size):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in j.join_components(df, tied=F.shiftright("doc_id", size)).collect())
    assert got == brute(docs, tie=lambda i: i >> size)


def test_ties_of_large_numbers(spark):
    high = 1 << 60
    rows = [(high, "a b c"), (high + 1, "d e f"), (high + 2, "g h i"), (high + 3, None), (None, "x y z")]
    got = {r.doc_id: r.component_id for r in j.join_components(spark.createDataFrame(rows, "doc_id long, text string"), tied=F.shiftright("doc_id", 1)).collect()}
    assert got == {high: high, high + 1: high, high + 2: high + 2, high + 3: high + 3, None: None}


def test_empty(spark):
    assert j.join_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert j.join_components(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 2


def test_components(spark):
    rng = random.Random(13)
    edges = [(i, i + 1) for i in range(100)] + [(500, 500)] + [(200, 201 + i) for i in range(50)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(150)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[a] == got[b] <= a for a, b in edges if a != b) and got[100] == 0 and got[250] == 200 and 500 not in got


def test_words_of_equal_polynomial_hashes_are_different(spark):
    from .colliding import PAIRS

    rows = [(10 * i + j, x) for i, pair in enumerate(PAIRS) for j, x in enumerate(pair)]
    assert all(r.doc_id == r.component_id for r in j.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())


@pytest.mark.parametrize("tile", [3, 1024])
def test_chains_of_near_copies_are_one_component(spark, tile, monkeypatch):
    """Each text is near the next one alone, so that neither stars nor one tile can tie them all."""
    monkeypatch.setattr(tiles, "TILE", tile)
    rng = random.Random(9)
    words = [f"v{i}" for i in range(400)]
    shared = [f"s{i}" for i in range(30)]
    docs = [(i, " ".join(shared + words[7 * i : 7 * i + 60])) for i in range(40)]
    docs += [(100 + i, " ".join(shared + [rng.choice(words) for _ in range(40)])) for i in range(30)]
    got = j.join_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(docs)
