import hashlib
import random
import time

import public_tokenizers
import pytest
from inkgraph.llm import bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)


TEXTS = ["", " ", "Hello, World's end!!", "a b c\x1cd \x85 e", "<|endoftext|>x<|STARTOFTEXT|> <|startoftext|>", "é ́x İ ΑΣ ſ K ß", "日本語テキスト 😀😀", "\x00\x01", "123 45.6"]


def test_as_the_library(library):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab cdéñ́'sT1<|>\n😀") for _ in range(rng.randrange(400))) for _ in range(300)]
    assert bpe.Codec(PATH, leaf=8).encode_all([t.encode() for t in texts]) == [expected(library, t) for t in texts]


@pytest.mark.parametrize("alphabet", ["ab", "the", "aeiou", "ééa", "!", "inthe"])
def test_long_unsplit(library, alphabet):
    rng = random.Random(2)
    texts = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (17, 64, 257, 1000, 5003)] + [alphabet * 700]
    for leaf in (2, 16, 256):
        assert bpe.Codec(PATH, leaf=leaf).encode_all([t.encode() for t in texts]) == [expected(library, t) for t in texts]


def test_small_cache(library):
    texts = ["one two three four", "five six one two", "three seven"] * 5
    assert bpe.Codec(PATH, cache=3).encode_all([t.encode() for t in texts]) == [expected(library, t) for t in texts]


def test_rows(spark, library):
    rows = [(1, "Some text here", 7), (None, "x", 7), (3, None, 7), (1, "Some text here", 7), (4, "", None)]
    got = bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH, keep=True).collect()
    want = []
    for i, t, _ in rows:
        n, ids, text = expected(library, t or "")
        want.append((i, n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), [int(x) for x in ids.split()], text))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_special_tokens_take_time_in_proportion():
    codec = bpe.Codec(PATH)
    took = []
    for n in (20_000, 40_000):
        text = "<|endoftext|>x" * n
        began = time.perf_counter()
        [(count, _, _)] = codec.encode_all([text.encode()])
        took.append(time.perf_counter() - began)
        assert count == 2 * n
    assert took[1] < 3.5 * took[0] + 0.2


def test_the_cache_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2000)
    codec, library = bpe.Codec(PATH), Tokenizer.from_file(PATH)
    for i in range(60):
        text = f"{'a' * (i * 7)} word{i} {'xyz' * 300}"
        [(n, ids, _)] = codec.encode_all([text.encode()])
        assert ids == " ".join(map(str, library.encode(text, add_special_tokens=False).ids))
        assert codec.held < 2000 + 3 * 4000 and len(codec.old) < 50
