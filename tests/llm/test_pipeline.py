"""The pipeline against a brute-force version of every stage on a small corpus."""

import hashlib
import random
import re

import corpus_pipeline
import public_tokenizers
import pytest
from inkgraph.llm import quality
from tokenizers import Tokenizer

from . import test_decontaminate, test_jaccard, test_lines


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(18)
    vocab = quality.COMMON_WORDS["en"] + [a + b for a in ("st", "th", "er", "in") for b in ("on", "ar", "el", "op", "es")]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item = line(30)
    texts = ["\n".join(line(rng.randrange(8, 40)) for _ in range(rng.randrange(2, 7))) for _ in range(60)]
    texts += texts[:5]  # copies
    texts += ["\n".join(x + " " + line(1) + " " + line(1) + " tail" if i == 0 else x for i, x in enumerate(t.split("\n"))) for t in texts[5:15]]
    texts += [texts[20] + "\n" + item, item.upper() + " " + line(60)]
    texts += ["short text", "", None, " ".join(w + "***" for w in line(200).split()), "same " * 200]
    shared = "a shared line of footer text in many documents"
    rows = [(i * 2, t if t is None or i % 4 else t + "\n" + shared, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(7, item), (8, line(12))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, [(7, item)]


def groups(docs, entered):
    """The least id of each group of documents that are near copies by the text they have or by that they entered with."""
    texts = [(2 * i, t) for i, t in docs] + [(2 * i + 1, entered[i]) for i, t in docs if entered[i] != t]
    label = {i: i for i, _ in docs}
    for x, _, c in map(eval, test_jaccard.brute(texts)):
        a, b = label[x // 2], label[c // 2]
        label = {i: min(a, b) if v in (a, b) else v for i, v in label.items()}
    return sorted(set(label.values()))


def test_stages(spark, tables):
    folder, rows, items = tables
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    # quality rules: the operator's own verdict is tested elsewhere
    verdict = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    want = [r for r in rows if verdict[r[0]]]
    assert 60 < len(want) < len(rows)
    steps = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, folder), "step")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        steps.append(sorted(tuple(r) for r in docs.collect()))
    assert steps[0] == sorted(want)
    # line dedup
    out = []
    for i, text, n_lines, removed in map(eval, test_lines.brute([(r[0], r[1]) for r in steps[0]])):
        if not removed or re.search(r"[^\x20\x09-\x0D]", text):
            out.append((i, text))
    assert [(r[0], r[1]) for r in steps[1]] == sorted(out)
    assert all(r[4] == len(r[1]) for r in steps[1] if r[1] != dict((x[0], x[1]) for x in rows)[r[0]])
    # one of each group of near copies
    assert [r[0] for r in steps[2]] == groups([(r[0], r[1]) for r in steps[1]], {r[0]: r[1] for r in rows})
    # benchmark
    clean = [i for i, *_, hit in map(eval, test_decontaminate.brute([(r[0], r[1]) for r in steps[2]], items)) if not hit]
    assert [r[0] for r in steps[3]] == sorted(clean)
    assert len(steps[0]) > len(steps[1]) >= len(steps[2]) > len(steps[3])
    # encoding, and the whole
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    last = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, folder).collect())
    ids = {r[0]: library.encode(r[1], add_special_tokens=False).ids for r in steps[3]}
    assert last == sorted((i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for i, x in ids.items())


def test_clean_rows_stay_beside_rejected_ones_of_their_id(spark, tmp_path):
    rng = random.Random(20)
    vocab = quality.COMMON_WORDS["en"] + ["stone", "there", "error"]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item = line(30)
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = [line(200) for _ in range(20)]
    rows = [(None if i % 2 else 1, x, "en", "s", len(x)) for i, x in enumerate(good)]
    bad = [(None, "short", "en", "s", 5), (1, None, "en", "s", None)]
    taken = [(i, line(60) + " " + item, "en", "s", 0) for i in (None, 1)]
    of = lambda x: spark.createDataFrame(x, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert sorted(r.text for r in corpus_pipeline.quality_rules(spark, of(rows + bad), str(tmp_path)).collect()) == sorted(good)
    assert sorted(r.text for r in corpus_pipeline.benchmark_decontamination(spark, of(rows + taken), str(tmp_path)).collect()) == sorted(good)


NAMES = "doc_id long, text string, lang string, source string, n_chars long, content_key string, Row_Number long, n_lines int, n_removed int, __hash string, __lines string, component string"


def test_a_near_copy_leaves_no_scrap(spark, tmp_path):
    rng = random.Random(21)
    vocab = [a + b for a in ("st", "th", "er", "in", "ba", "ko") for b in ("on", "ar", "el", "op", "es")]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    first = [line(12) for _ in range(20)]
    second = [x if i % 4 else x + " tail " + line(1) for i, x in enumerate(first)]
    rows = [(1, "\n".join(first), "en", "s", 0), (2, "\n".join(second), "en", "s", 0), (3, line(200), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    cut = corpus_pipeline.written(corpus_pipeline.line_dedup(spark, docs, str(tmp_path)), "cut")
    assert cut.count() == 3 and len(cut.where("doc_id = 2").first().text) < len(rows[1][1]) / 2
    assert sorted(r.doc_id for r in corpus_pipeline.jaccard_join(spark, cut, str(tmp_path)).collect()) == [1, 3]


def test_rows_that_share_an_id_or_have_none(spark, tmp_path):
    rng = random.Random(22)
    vocab = quality.COMMON_WORDS["en"] + ["stone", "there", "error"]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    same, others = line(100), [line(100) for _ in range(3)]
    texts = [(1, same), (1, same), (None, same), (None, same), (1, others[0]), (None, others[1]), (2, others[2]), (4, None), (5, "")]
    rows = [(i, t, "en", None, None, "k", 7, 1, 1, "h", "l", "c") for i, t in texts]
    docs = spark.createDataFrame(rows, NAMES).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, line(20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.jaccard_join(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted(repr((r.doc_id, r.text)) for r in out.collect()) == sorted(map(repr, [(1, same), (1, others[0]), (None, others[1]), (2, others[2]), (4, None), (5, "")]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.columns == docs.columns and empty.count() == 0, name
        assert others[1] in [r.text for r in got.collect()], name
    assert corpus_pipeline.encode(spark, docs, str(tmp_path)).count() == len(rows)
    assert corpus_pipeline.encode(spark, docs.limit(0), str(tmp_path)).count() == 0
