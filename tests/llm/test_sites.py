import random

import pytest
from inkgraph.llm import sites
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string, lang string, toxic string"


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(1500):
        text = [rng.choice(words) for _ in range(60)]
        toxic = rng.random() < 0.15
        junk = rng.random() < 0.15
        if toxic:
            for _ in range(3):
                text[rng.randrange(60)] = rng.choice(["vile", "scum", "idiot"])
        if junk:
            text = [w.upper() + "!!" for w in text]
        docs.append((i, " ".join(text), f"s{i % 7}" if i % 50 else None, "en", "x"))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


def classify(spark, docs, labels):
    df = spark.createDataFrame(docs, SCHEMA)
    return sites.classify(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.col("source"), F.concat_ws("/", "source", "lang"))


def test_held_out(spark, data):
    docs, labels = data
    rows = {r.doc_id: r for r in classify(spark, docs, [x for x in labels if x[0] % 2]).collect()}
    held = [x for x in labels if x[0] % 2 == 0]
    right = sum(rows[i].kept == (q == 1 and not t) for i, q, t in held)
    assert right / len(held) > 0.97
    assert all(rows[i].kept for i, q, t in held if q and not t and i % 10 == 0)


def test_edges(spark, data):
    docs, labels = data
    extra = [(None, "w1", "s1", None, None), (None, "w1", "s1", None, None), (5000, None, None, None, None), (5001, "", "only", "en", None), (5002, "w1 " * 30000, "s1", "en", None), docs[0]]
    got = classify(spark, docs + extra, labels + [(None, 0, 1), (0, 1, 0), (7000, None, None)]).collect()
    assert len(got) == len(docs) + len(extra) and all(0 <= r.p_toxic <= 1 for r in got)
    none = classify(spark, docs[:20], [])
    assert none.where("kept").count() == 20
    assert classify(spark, [], labels).count() == 0


def test_sparse_sites_shrink(spark):
    """A host of one bad labelled document moves little; a host of many moves far."""
    docs = [(i, f"text number {i}", "bad", "p", "") for i in range(200)] + [(200 + i, f"text number {i}", f"h{i % 100}", "p", "") for i in range(2000)] + [(3000, "a", "new", "p", ""), (3001, "b", "new", "p", "")]
    labels = [(i, int(i % 10 == 0), 0) for i in range(200)] + [(200 + i, 1, 0) for i in range(2000)] + [(3000, 0, 0)]
    rows = {r.doc_id: r for r in classify(spark, docs, labels).collect()}
    assert rows[3].host_rate_low_quality > 0.8 > 0.7 > rows[3001].host_rate_low_quality > rows[250].host_rate_low_quality
