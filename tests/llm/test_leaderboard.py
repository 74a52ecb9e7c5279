"""The change feed against a plain version, and the state of a shard."""

import datetime as dt
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from inkgraph.llm import leaderboard as L

LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, flag string, shipped_at timestamp_ntz, n long"
VENDORS, ITEMS = "vendor_id long, nation_id int, n long", "item_id long, price double, n long"


def plain(lines, vendors, items):
    nation, price = {v[0]: v[1] for v in vendors}, {i[0]: i[1] for i in items}
    batches = defaultdict(list)
    for sale, no, item, vendor, quantity, amount, flag, shipped, *_ in lines:
        h = zlib.crc32(",".join("" if x is None else str(x) for x in (sale, item, vendor, no)).encode())
        s = (shipped.date() - dt.date(1970, 1, 1)).days if shipped else 19723 + h % 150
        a = s + h % 7 + (20 if h % 5 == 0 else 0)
        finite = lambda x: x is not None and math.isfinite(x)
        cents = 0
        if finite(amount):
            cents = math.floor(100 * amount + 0.5)
        elif quantity is not None and finite(price.get(item)):
            cents = quantity * math.floor(100 * price[item] + 0.5)
        batches[max(1, min(8, 1 + (a - 19723) * 8 // 180))].append((s, a, nation.get(vendor), item, -cents if flag == "swapped" else cents))
    most, deltas = None, defaultdict(lambda: defaultdict(list))
    for b in sorted(batches):
        for s, a, n, item, cents in batches[b]:
            if n is not None and item in price and item is not None and (most is None or s + 15 >= most):
                deltas[n][a].append((item, cents))
        most = max([s for s, *_ in batches[b]] + ([] if most is None else [most]))
    out = []
    for n, days in deltas.items():
        revenue, board = defaultdict(int), {}
        for a in sorted(days):
            for item, cents in days[a]:
                revenue[item] += cents
            top = sorted((i for i in revenue if revenue[i] > 0), key=lambda i: (-revenue[i], i))[:10]
            now = {i: k + 1 for k, i in enumerate(top)}
            for i in {*board, *now}:
                if board.get(i) != now.get(i):
                    change = "enter" if i not in board else "exit" if i not in now else "move"
                    out.append((n, a, i, max(1, min(8, 1 + (a - 19723) * 8 // 180)), change, board.get(i), now.get(i), revenue[i]))
            board = now
    return sorted(out, key=repr)


def feed(spark, lines, vendors, items):
    got = L.change_feed(spark.createDataFrame(lines, LINES), spark.createDataFrame(vendors, VENDORS), spark.createDataFrame(items, ITEMS))
    assert got.dtypes == [("nation_id", "int"), ("arrival_day", "bigint"), ("item_id", "bigint"), ("batch", "int"), ("change", "string"), ("old_rank", "int"), ("new_rank", "int"), ("revenue", "bigint")]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_feed_as_plain(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_LINES", 150)  # several shards for each nation
    rng = random.Random(3)
    maybe = lambda x, p=0.05: None if rng.random() < p else x
    lines = []
    for i in range(600):
        day = dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(160) if rng.random() < 0.9 else rng.randrange(-30, 700), hours=rng.randrange(24))
        amount = maybe(rng.choice([rng.randrange(1, 4000) / 100, -3.5, 10.005, float("nan"), float("inf")]), 0.2)
        vendor = 0 if rng.random() < 0.4 else rng.randrange(9)
        item = 3 if rng.random() < 0.3 else rng.randrange(40)
        lines.append((maybe(i // 3), maybe(i % 7), maybe(item), maybe(vendor), maybe(rng.randrange(1, 9)), amount, maybe(rng.choice(["kept", "swapped", "returned"])), maybe(day), i))
    lines += lines[:40]  # repeats count
    vendors = [(v, None if v == 7 else v % 3, 0) for v in range(8)]
    items = [(i, None if i == 5 else float("nan") if i == 6 else 2.5 + i, 0) for i in range(38)]
    assert feed(spark, lines, vendors, items) == plain(lines, vendors, items)


def test_ties_and_days_without_change(spark):
    day = dt.datetime(2024, 2, 1)
    lines = [(1, k, item, 1, 1, 5.0, "kept", day, 0) for k, item in enumerate([*range(12, 0, -1)])]
    got = feed(spark, lines, [(1, 4, 0)], [(i, 1.0, 0) for i in range(13)])
    assert got == plain(lines, [(1, 4)], [(i, 1.0) for i in range(13)])
    assert all(r[7] == 500 for r in got)


@pytest.mark.parametrize("lines", [[], [(None,) * 9], [(1, 1, 1, 1, None, None, None, None, None)]])
def test_empty_and_null(spark, lines):
    assert feed(spark, lines, [], []) == []
    assert feed(spark, lines, [(1, 2, 0), (None, 3, 0)], [(1, None, 0), (None, 2.0, 0)]) == []


def test_shard_state_is_whole():
    rng = np.random.default_rng(5)
    shard, total = L.Shard(None), defaultdict(float)
    for day in range(0, 40, 2):
        items, cents = rng.integers(0, 60, 50), rng.integers(-500, 900, 50).astype(float)
        shard.buffer(np.full(50, day), items, cents)
        shard = L.Shard(shard.packed())
        for i, c in zip(items, cents, strict=True):
            total[int(i)] += c
    assert shard.timer() == L.DAY_MS - 1
    list(shard.fold(11 * L.DAY_MS))
    assert int(shard.days[0]) == 12  # days 0 to 10 ended
    shard = L.Shard(shard.packed())
    days = [d for d, *_ in shard.fold(1000 * L.DAY_MS)]
    assert days == sorted(days) and not len(shard.days) and shard.timer() is None
    assert {int(i): c for i, c in zip(shard.items, shard.cents, strict=True)} == dict(total)


def test_numbers_are_packed():
    for x in (np.zeros(0, np.int64), np.array([-(1 << 63), 0, (1 << 63) - 1])):
        assert np.array_equal(L.unpack(L.pack(x)), x)
    assert L.unpack(L.pack(np.array([0.5, -1e300])), np.float64).tolist() == [0.5, -1e300]


def test_settings_are_restored(spark):
    spark.conf.set("spark.sql.streaming.minBatchesToRetain", "7")
    with pytest.raises(ZeroDivisionError), L.settings(spark, spark__sql__streaming__minBatchesToRetain="2", spark__sql__streaming__noDataMicroBatches__enabled="false"):
        assert spark.conf.get("spark.sql.streaming.minBatchesToRetain") == "2"
        raise ZeroDivisionError
    assert spark.conf.get("spark.sql.streaming.minBatchesToRetain") == "7"
    spark.conf.unset("spark.sql.streaming.minBatchesToRetain")
