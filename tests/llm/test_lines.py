import random

import numpy as np
import pyarrow as pa
import pytest
from inkgraph.llm import lines as m


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(rng, s, edits):
    s = list(s)
    for _ in range(edits):
        at = rng.randrange(len(s) + 1)
        s[at : at + rng.choice([0, 1])] = rng.choice([[], ["x"], ["é"]])
    return "".join(s)


def brute(docs, edits=2, least=20):
    seen, places = {}, []
    for row, (doc, text) in enumerate(docs):
        for i, line in enumerate((text or "").split("\n") if text is not None else []):
            if len(line.encode()) >= least:
                places.append(((m.LAST if doc is None else doc, i), line, row))
                seen.setdefault(line, len(seen))
    keys = list(seen)
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    raw = [k.encode() for k in keys]
    for i in range(len(raw)):
        for j in range(i):
            if abs(len(raw[i]) - len(raw[j])) <= edits and find(i) != find(j) and distance(raw[i], raw[j]) <= edits:
                parent[find(i)] = find(j)
    least_of = {}
    for at, line, _ in places:
        c = find(seen[line])
        least_of[c] = min(least_of.get(c, at), at)
    gone = {(row, at[1]) for at, line, row in places if at != least_of[find(seen[line])]}
    out = []
    for row, (doc, text) in enumerate(docs):
        parts = [] if text is None else text.split("\n")
        kept = None if text is None else "\n".join(x for i, x in enumerate(parts) if (row, i) not in gone)
        out.append(repr((doc, kept, len(parts), sum((row, i) in gone for i in range(len(parts))))))
    return sorted(out)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(14)
    words = ["the", "of", "tion", "été", "er", "on", "st"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bases = [line(rng.randrange(4, 12)) for _ in range(40)] + ["a" * 20, "a" * 21, "ab" * 12, "short", "", "same line in a third of all rows"]
    out = []
    for i in range(160):
        parts = [changed(rng, rng.choice(bases), rng.choice([0, 0, 1, 2, 3, 5])) for _ in range(rng.randrange(6))] + [bases[-1]] * (i % 3 == 0)
        rng.shuffle(parts)
        out.append((i, "\n".join(parts)))
    out += [(200, None), (201, ""), (202, "\n\n"), (None, bases[0]), (None, bases[0] + "\n" + bases[1]), out[0], (203, "a long line of text " * 100), (204, "a long line of text " * 100 + "y")]
    return out


def test_is_brute_force(spark, docs):
    df = spark.createDataFrame([(i, "k", t, "x") for i, t in docs], "doc_id long, line string, text string, n_lines string").repartition(3)
    got = m.dedup_lines(df)
    assert got.columns == ["doc_id", "line", "text", "n_lines", "n_removed"]
    assert sorted(repr((r.doc_id, r.text, r.n_lines, r.n_removed)) for r in got.collect()) == brute(docs)


def test_empty(spark):
    assert m.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert m.line_report(spark.createDataFrame([(1, None), (2, "x")], "doc_id long, text string")).count() == 2


def test_within():
    rng = random.Random(15)
    a = ["".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(3000)]
    b = [changed(rng, x, rng.randrange(5)) for x in a]
    for edits in (0, 1, 2, 3):
        got = m.within(pa.array([x.encode() for x in a], pa.binary()), pa.array([x.encode() for x in b], pa.binary()), edits)
        assert got.tolist() == [distance(x.encode(), y.encode()) <= edits for x, y in zip(a, b, strict=True)]


def test_line_spans():
    texts = ["a\nb", "", "\n", "x\n", "\ny"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.r_[0, np.cumsum([len(t) for t in texts])]
    starts, stops, owner, number = m.line_spans(data, ends)
    got = [[] for _ in texts]
    for a, b, o, n in zip(starts, stops, owner, number, strict=True):
        assert n == len(got[o])
        got[o].append(data[a:b].tobytes().decode())
    assert got == [t.split("\n") for t in texts]


def test_short_repeats_and_code_points(spark):
    cjk = "一二三四五六七八九十百千"
    rows = [(1, "short\n\n" + cjk + "\nab"), (2, "short\nab\n\n" + cjk[:5] + "語" + cjk[5:]), (3, cjk[:4] + "語" + cjk[5:-1] + "\nac"), (4, "語文字" + cjk[3:])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in m.dedup_lines(df, exact=1, chars=True).collect()}
    assert got == {1: rows[0][1], 2: "", 3: "ac", 4: rows[3][1]}
    assert {r.doc_id: r.n_removed for r in m.line_report(df).collect()} == {1: 0, 2: 3, 3: 1, 4: 0}


def test_within_code_points():
    rng = random.Random(16)
    a = ["".join(rng.choice("aé語😀") for _ in range(rng.randrange(12))) for _ in range(2000)]
    b = [changed(rng, x, rng.randrange(5)) for x in a]
    for edits in (0, 2):
        got = m.within(pa.array([x.encode() for x in a], pa.binary()), pa.array([x.encode() for x in b], pa.binary()), edits, chars=True)
        assert got.tolist() == [distance(x, y) <= edits for x, y in zip(a, b, strict=True)]


def test_within_long_lines(monkeypatch):
    """Edits far apart in long lines, compared a few symbols at once."""
    monkeypatch.setattr(m, "SYMBOLS", 64)
    rng = random.Random(17)
    a = ["".join(rng.choice("ab語") for _ in range(rng.choice([0, 15, 16, 17, 150, 300]))) for _ in range(120)]
    b = [changed(rng, x, rng.randrange(5)) for x in a]
    for edits in (0, 1, 2, 3):
        got = m.within(pa.array([x.encode() for x in a], pa.binary()), pa.array([x.encode() for x in b], pa.binary()), edits, chars=True)
        assert got.tolist() == [distance(x, y) <= edits for x, y in zip(a, b, strict=True)]


def test_bit_map_takes_no_job_for_each_partition(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("bit-map", "")
    try:
        nodes = np.arange(100, dtype=np.int64)
        pairs = spark.createDataFrame([(bytearray(nodes.tobytes()), bytearray((nodes + 100).tobytes()))], "a binary, b binary")
        packed = m._bloom(pairs, 200)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("bit-map")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
    assert m.bloom_has(packed, np.arange(200, dtype=np.int64)).all()
    assert len(jobs) <= 3
