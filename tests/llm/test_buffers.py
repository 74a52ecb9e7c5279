import numpy as np
from inkgraph.llm.buffers import digests, distinct_spans

from .colliding import PAIRS


def spans(texts):
    ends = np.r_[0, np.cumsum([len(t) for t in texts])]
    return np.frombuffer(b"".join(texts), np.uint8), ends[:-1], ends[1:]


def test_digests_tell_contents_apart():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(0, 3, n, dtype=np.uint8)) for n in range(40) for _ in range(20)]
    texts += [b"a", b"a\0", b"\0a", b"a" * 7, b"a" * 8, b"a" * 8 + b"\0", b"a" * 15, b"a" * 16, b"", b"\0" * 15]
    texts += [x.encode() for pair in PAIRS for x in pair]
    out = [tuple(x) for x in digests(*spans(texts), b"k").tolist()]
    assert len(dict(zip(texts, out, strict=True))) == len(set(texts)) == len(set(out))
    assert all(x == dict(zip(texts, out, strict=True))[t] for t, x in zip(texts, out, strict=True))
    assert len({x[0] for x in out}) == len(set(out)) and set(out).isdisjoint(tuple(x) for x in digests(*spans(texts), b"l").tolist())
    assert digests(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), b"k").shape == (0, 2)


def test_distinct_spans():
    contents, number = distinct_spans(*spans([b"x", b"yy", b"x", b"", b"yy"]))
    assert [contents[int(i)].as_py() for i in number] == [b"x", b"yy", b"x", b"", b"yy"] and len(contents) == 3


def test_runs_of_a_sorted_array():
    from inkgraph.llm.buffers import runs

    assert runs(np.array([2, 2, 5, 1 << 40])) == [(2, 0, 2), (5, 2, 3), (1 << 40, 3, 4)]
    assert runs(np.zeros(0, np.int32)) == []
