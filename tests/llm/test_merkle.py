"""The manifest against a plain version, and the algebra of forests."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from inkgraph.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, part int, row string, tree string, digest string"


def h(x):
    return sha256(x.encode()).hexdigest()


def leaf(row, more=0):
    values = [row[0], row[1], row[2], None if row[3] is None else row[3] + more, row[4]]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, i):
    """(sibling, its side) of each level, None where there is none."""
    for nodes in tree[:-1]:
        yield (nodes[i ^ 1], i & 1) if i ^ 1 < len(nodes) else None
        i >>= 1


def plain(rows):
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for v in langs.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {k: levels([leaf(r) for r in v]) for k, v in langs.items()}
    top = levels([trees[k][-1][0] for k in names])
    out = []
    for t, k in enumerate(names):
        for i, r in enumerate(langs[k]):
            steps = [*path(trees[k], i), *path(top, t)]
            now = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(r)
            for s in steps:
                now = h(now if s is None else s[0] + now if s[1] else now + s[0])
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], h("".join(s[0] for s in steps if s)), now, now == top[-1][0]))
    return sorted(out, key=repr)


def manifest(spark, rows):
    return sorted((tuple(r) for r in M.manifest(spark.createDataFrame([(*r, 1, "r", "t", "d") for r in rows], SCHEMA)).collect()), key=repr)


@pytest.mark.parametrize("langs", [["en"], ["en", "de", None], ["é", "z", "", None, "￿", "\U0001f600"]])
def test_manifest_as_plain(spark, langs):
    rng = random.Random(len(langs))
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "s", "ü"]), rng.choice(langs), rng.choice([None, 0, 7]), rng.choice([None, "", "text 😀"])) for _ in range(83)]
    assert manifest(spark, rows) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8])
def test_small_trees(spark, n):
    rows = [(i, "s", "en", i, "x") for i in range(n)]
    assert manifest(spark, rows) == plain(rows)


def test_repeated_rows_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(M, "FAN", 3)
    monkeypatch.setattr(M, "PART_LEAVES", 500)  # over 10,000 leaves are dealt to parts
    rows = [(i % 4000, "s", "ab"[i % 3 == 0], 1, "same") for i in range(11_000)] + [(9, "s", "a", 1, "hot")] * 3000
    assert manifest(spark, rows) == plain(rows)


def test_tampering_is_found(spark):
    rows = [(i, "s", "en", i, "x") for i in range(200)]
    got = {r[0]: r[6] for r in manifest(spark, rows)}
    assert got == {i: zlib.crc32(str(i).encode()) % 7 != 0 for i in range(200)}


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 70), st.randoms())
def test_forests_merge_in_any_order(n, rng):
    leaves = [h(str(i)) for i in range(n)]
    tree = levels(leaves)
    cuts = sorted({0, n, *(rng.randrange(n + 1) for _ in range(5))})
    forests = [dict(((level, i), x) for level, i, x in M.open_nodes(M.levels_of(a, leaves[a:b], n), n)) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
    for f in forests:
        assert len(f) <= 4 * len(tree) and all(tree[level][i] == x for (level, i), x in f.items())
    while len(forests) > 1:  # any two, neighbours or not
        a, b = (forests.pop(rng.randrange(len(forests))) for _ in range(2))
        both = a | b
        M.resolve(both, n)
        forests.append(both)
    assert forests == [{(len(tree) - 1, 0): tree[-1][0]}]
