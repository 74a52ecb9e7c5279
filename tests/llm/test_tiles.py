import numpy as np
from inkgraph.llm import tiles


def test_tiles_find_each_pair_between_components_once():
    rng = np.random.default_rng(4)
    rows = [(run, node, int(rng.integers(0, 9)), node % 4) for run in range(6) for node in rng.choice(30, 12, replace=False).tolist()]
    want = {(min(a[1], b[1]), max(a[1], b[1])) for a in rows for b in rows if a[0] == b[0] and a[3] != b[3] and a[2] + b[2] > 6}
    run, node, value, component = map(np.array, zip(*rows, strict=True))
    got = []
    for x in range(3):
        for y in range(x, 3):
            at = np.isin(node % 3, (x, y))
            c = {"run": run[at], "node": node[at], "component": component[at], "part": (node % 3)[at], "x": np.full(at.sum(), x), "y": np.full(at.sum(), y)}
            own = value[at]
            i, j = tiles.pairs_of_tile(c, lambda i, j, own=own: own[i] + own[j] > 6)
            got += [(min(p), max(p)) for p in zip(c["node"][i].tolist(), c["node"][j].tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


def test_large_leads_are_dealt_as_packs_and_few_members_of_many_groups_are_not_copied(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 40)
    monkeypatch.setattr(tiles, "TILE_ROWS", 2000)
    rows = [(run, node, 1, node % 5) for run in range(20) for node in range(200)]  # several parts
    rows += [(100 + run, 1000 + node, 2, node % 5) for run in range(300) for node in range(20)]  # one part, several slices
    dealt = tiles.deal(spark.createDataFrame(rows, "run long, node long, lead long, component long")).toPandas()
    assert len(dealt[dealt["pack"].isna()]) == 300 * 20  # each entry once
    packs = dealt[dealt["pack"].notna()]
    parts = packs["y"].max() + 1
    assert parts >= 5 and len(packs) == parts**2  # as many packs as there are sides of tiles, whatever the number of entries
    got = set()
    import pyarrow as pa

    for _, t in dealt.groupby("group"):
        for c in tiles.each_tile(pa.Table.from_pandas(t, preserve_index=False, schema=pa.schema([(n, pa.binary() if n == "pack" else pa.int64()) for n in t.columns])), []):
            i, j = tiles.pairs_of_tile(c, lambda i, j: np.ones((len(i), j.shape[1]), bool))
            got |= {(min(p), max(p)) for p in zip(c["node"][i].tolist(), c["node"][j].tolist(), strict=True)}
    assert got == {(a, b) for lo, hi in ((0, 200), (1000, 1020)) for a in range(lo, hi) for b in range(a + 1, hi) if (a - b) % 5}
