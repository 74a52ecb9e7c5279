import math
import random
import re
from collections import Counter

from inkgraph.llm import quality

SCHEMA = "doc_id long, text string, lang string, n_words string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed


def test_base_is_brute_force(spark):
    rng = random.Random(4)
    vocab = ["a", "bb", "the", "é", "\U0001f600", "#x", "|", "\n", "\n \n", "\t", "\x0b", "\x1c", " "]
    texts = [" ".join(rng.choice(vocab[: rng.randrange(3, 14)]) for _ in range(rng.randrange(120))) for _ in range(200)]
    texts += [None, "", "a", "a b c", "a b c a b c", "a a a a", "x\nx\n\n\nx", " ".join(f"w{i}" for i in range(5000)), "same words " * 4000]
    rows = [(i, t, rng.choice(["en", "xx", None]), "z") for i, t in enumerate(texts)] + [(None, "a b", "en", None), (0, texts[0], "en", None)]
    got = quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    want = sorted(repr((r[0], *brute(r[1]))) for r in rows)
    assert sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def js(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    return math.sqrt(sum(x * math.log2(2 * x / (x + y)) / 2 for v, w in ((p, q), (q, p)) for x, y in zip(v, w, strict=True) if x))


def test_distance_and_verdict(spark):
    df = spark.createDataFrame([([3, 1, 0], [10, 20, 30]), ([1, 1, 1], [2, 2, 2]), ([0, 0, 0], [1, 1, 1])], "a array<long>, b array<long>")
    got = [r[0] for r in df.select(quality.jensen_shannon(df.a, df.b)).collect()]
    assert abs(got[0] - js([3, 1, 0], [10, 20, 30])) < 1e-12 and got[1] == 0 and got[2] is None
    rng = random.Random(5)
    vocab = quality.COMMON_WORDS["en"] + [a + b for a in ("st", "th", "er") for b in ("on", "in", "ar", "el", "op")]
    clean = [(i, " ".join(rng.choice(vocab) for _ in range(200)), "en", "") for i in range(30)]
    junk = [(100, " ".join(w + "***" for w in clean[0][1].split()), "en", ""), (101, " ".join(f"w{i}x{i}" for i in range(300)), "en", ""), (102, clean[1][1].upper(), "en", "")]
    kept = {r.doc_id for r in quality.judge(spark.createDataFrame(clean + junk, SCHEMA)).where("kept").collect()}
    assert kept == {r[0] for r in clean}
