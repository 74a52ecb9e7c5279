import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from inkgraph.llm import suffix_tree as t
from inkgraph.llm.buffers import ASCII_LOWER, text_buffer

LOWER = {i: i + 32 for i in range(65, 91)}


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), "<end>"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(10)
    parts = ["the", "of", "on", "in", "tion", "er", "Été", "re", "st", "an"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))
    texts = ["".join(word() + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(rng.randrange(200))).strip() for _ in range(300)]
    out = list(enumerate(texts)) + [(1000, None), (1001, ""), (1002, " \n "), (None, "the end"), (3, texts[3]), (1003, "the " * 4000)]
    return out


def test_base_is_brute_force(spark, rows):
    train = [x for i, text in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2 for x in tokens(text)]
    count = Counter(train)
    n, v = len(train), len(count)
    want = sorted((str(i), zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2, len(tokens(x)), sum(count[w] > 0 for w in tokens(x)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(x)), 6)) for i, x in rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(3)
    got = t.score_documents(df, gain=5.0).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert t.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_of_colliding_polynomials_are_different(spark):
    from .colliding import PAIRS

    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]
    seen = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [(i, pair[k]) for k, ids in enumerate((seen, held)) for i, pair in zip(ids, PAIRS, strict=False)]
    got = t.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.held_out, r.n_known) for r in got) == sorted((i, i in held, 1 if i in held else 2) for i, _ in rows)


def test_tree_is_a_model_and_beats_order_zero(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tree, flat = t.train(df, gain=5.0), t.train(df, gain=1e18)
    assert len(flat.contexts) == 0 < len(tree.contexts)
    assert np.allclose(tree.probs.sum(axis=1), 1, atol=1e-4)
    kept = set(tree.contexts)
    assert all(d == 1 or (d - 1, c % 64 ** (d - 1)) in kept for d, c in kept)
    held = pa.array([x or "" for i, x in rows if not t.is_training(i)])
    data, ends = text_buffer(held)
    assert tree.score(ASCII_LOWER[data], ends).sum() > flat.score(ASCII_LOWER[data], ends).sum() * 0.9
    # the longest kept suffix, symbol by symbol
    state = {c: i + 1 for i, c in enumerate(tree.contexts)}
    for text in held.to_pylist()[:20]:
        stream = [s for w in tokens(text)[:-1] for s in [*(int(tree.symbols[b]) for b in w.encode()), 0]] + [63]
        history, total = [63] * tree.depth, 0.0
        for s in stream:
            at = next((state[d, c] for d in range(tree.depth, 0, -1) if (d, c := sum(x << 6 * k for k, x in enumerate(history[:d]))) in state), 0)
            total += math.log10(tree.probs[at, s]) - (s == 62) * math.log10(max(1, sum(int(tree.symbols[b]) == 62 for b in range(256))))
            history = [s, *history[:-1]]
        data, ends = text_buffer(pa.array([text]))
        assert abs(tree.score(ASCII_LOWER[data], ends)[0] - total) < 1e-3 * max(1, -total)


def test_all_states_are_kept_and_scored_by_shard(spark):
    rng = random.Random(19)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    texts = ["".join(rng.choice(letters) for _ in range(4000)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(30, "AB Éß"), (31, None)], "doc_id long, text string").repartition(3)
    tree = t.train(df, gain=1e-6)
    assert len(tree.contexts) > 60_000
    data, ends = text_buffer(pa.array(texts + ["AB Éß", ""]))
    want = dict(zip([*range(20), 30, 31], tree.score(ASCII_LOWER[data], ends), strict=True))
    got = {r.doc_id: r.score for r in t.score_documents(df, gain=1e-6).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - x) < 1e-6 * max(1, -x) for i, x in want.items())
