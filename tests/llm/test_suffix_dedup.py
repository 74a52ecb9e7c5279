import hashlib
import random

import numpy as np
import pytest
from inkgraph.llm import sais
from inkgraph.llm import suffix_dedup as s


def test_suffix_array_is_sorted():
    rng = random.Random(16)
    for n in [1, 2, 3, 10, 50, 200, 1000]:
        for alphabet in (1, 2, 3, 26):
            text = np.array([rng.randrange(alphabet) for _ in range(n)], np.uint16)
            raw = text.astype(np.uint8).tobytes()
            want = sorted(range(n), key=lambda i: raw[i:])
            assert sais.suffix_array(text, alphabet).tolist() == want
            order = np.array(want)
            common = sais.permuted_common_prefixes(text, order, 7)
            for a, b in zip(want, want[1:], strict=False):
                k = 0
                while k < 7 and max(a, b) + k < n and raw[a + k] == raw[b + k]:
                    k += 1
                assert common[b] == k
            cut = sais.suffix_array(text, alphabet, 4).tolist()
            assert [raw[i : i + 4] for i in cut] == [raw[i : i + 4] for i in want]


def brute(docs, length=50):
    first = {}
    for i, t in docs:
        raw = (t or "").encode()
        if i is not None:
            for a in range(len(raw) - length + 1):
                w = raw[a : a + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        if i is not None:
            for a in range(len(raw) - length + 1):
                if first[raw[a : a + length]] < i:
                    gone[a : a + length] = b"\1" * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out.append(repr((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())))
    return sorted(out)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(17)
    words = ["the", "of", "tion", "été", "er", "on", "st", "a", "in", "\n"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(rng.randrange(8, 60)) for _ in range(12)] + ["ab" * 60, "x" * 130]
    out = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += [p[a : a + rng.choice([30, 49, 50, 51, 80, 400])], text(rng.randrange(12))]
        out.append((rng.randrange(300), rng.choice(["", " "]).join(parts)))
    out += [(i, out[k][1]) for k, i in enumerate(range(400, 440))] + [(440, None), (441, ""), (None, out[0][1]), (None, passages[0]), out[0], (442, passages[0] * 300), (443, "\0" * 60), (444, "y\0" + "\0" * 60)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("shards", [1, 9])
def test_is_brute_force(spark, docs, shards, monkeypatch):
    if shards == 1:
        monkeypatch.setattr(s, "SHARD_BYTES", 4000)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, block string").repartition(3)
    got = s.dedup_strings(df, shards=shards, keep=True).collect()
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == brute(docs)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_parts_keep_equal_strings_together(spark, docs):
    texts = [t for i, t in docs if i is not None and t and len(t.encode()) >= 50]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    a = s.Anchors(raw, ends, np.ones(len(texts), bool), 50, 24)
    sizes = a.owned + 49
    assert int(a.owned.sum()) == sum(len(t.encode()) - 49 for t in texts)
    text = s._gather(raw, a.starts, sizes)
    starts = np.cumsum(sizes) - sizes
    old, s.SHARD_BYTES = s.SHARD_BYTES, 2000
    try:
        parts = s._parts(text, starts, sizes, np.arange(len(sizes)), 50, 24)
    finally:
        s.SHARD_BYTES = old
    where = {}
    for k, p in enumerate(parts):
        for i in p:
            for w in range(a.owned[i]):
                assert where.setdefault(text[starts[i] + w : starts[i] + w + 50].tobytes(), k) == k


def test_empty(spark):
    assert s.dedup_strings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
