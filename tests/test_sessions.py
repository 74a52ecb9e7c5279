"""Sessions settle alike however their events are dealt, and each is emitted once."""

import random
import uuid

import pandas as pd
import pytest
from inkgraph.sources import corpus as C
from inkgraph.sources.tables import shared_dir
from inkgraph.streaming import sessions as S
from pyspark.sql import functions as F


def plain(events, gap):
    out, now = [], []
    for t, p in [*sorted(events, key=lambda e: (e[0], e[1] is None, e[1] or "")), (1 << 60, None)]:
        if now and t - now[-1][0] > gap:
            out.append((now[0][0], now[-1][0], "gap", [x for _, x in now]))
            now = []
        if p is None:
            if now:
                out.append((now[0][0], t, "stop", [x for _, x in now]))
            now = []
        else:
            now.append((t, p))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_settled_at_any_watermarks(seed):
    rng = random.Random(seed)
    events = [(rng.randrange(300), rng.choice(["a", "b", None])) for _ in range(rng.randrange(25))]
    known, got, left = [], [], sorted(events, key=lambda e: e[0])
    for watermark in [*sorted(rng.randrange(320) for _ in range(6)), 1 << 50]:
        known = sorted(known + [e for e in left if e[0] <= watermark + 40], key=lambda e: (e[0], e[1] is None, e[1] or ""))
        left = [e for e in left if e[0] > watermark + 40]
        over, known, at = S.settled(known, 12, watermark)
        got += over
        assert at is None or at > watermark
    assert got == plain(events, 12) and not known


@pytest.mark.parametrize("seed", range(5))
def test_sessions_of_a_bucket_settle_together(seed):
    rng = random.Random(seed)
    events = [(rng.choice(["s", "t", "u", None]), rng.randrange(300), rng.choice(["a", "b", None])) for _ in range(80)]
    known, got = pd.DataFrame({"session": [], "ms": [], "path": []}), []
    for watermark in (-1, 100, 100, 250, 1 << 50):
        fresh = [e for e in events if watermark == 1 << 50 or e[1] <= watermark + 40]
        events = [e for e in events if e not in fresh]
        frame = pd.DataFrame(fresh, columns=["session", "ms", "path"], dtype=object)
        over, known, at = S.settle(pd.concat([known, frame], ignore_index=True), 12, watermark)
        assert at is None or at > watermark
        got += [(None if pd.isna(s) else s, a, b, why, sorted(paths)) for s, a, b, why, paths in zip(over["session"], over["started"], over["ended"], over["reason"], over["paths"], strict=True)]
    assert len(known) == 0
    rng = random.Random(seed)
    events = [(rng.choice(["s", "t", "u", None]), rng.randrange(300), rng.choice(["a", "b", None])) for _ in range(80)]
    want = [(s, a, b, why, sorted(paths)) for s in ("s", "t", "u", None) for a, b, why, paths in plain([e[1:] for e in events if e[0] == s], 12)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stream_over_restarts(spark):
    folder = f"{shared_dir(spark)}/test-sessions-{uuid.uuid4().hex}"
    minute = lambda m, s, p: (m, s, p)
    batches = [
        [minute(0, "s", "a.md"), minute(5, "s", "b.md"), minute(3, "t", "a.md")],
        [minute(2, "s", "late.md"), minute(9, "s", None), minute(50, "t", "c.md")],
        [minute(6, "s", "too-late.md"), minute(200, "u", "d.md")],  # behind the watermark by now
        [minute(9000, "", None)],
    ]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "m long, session string, path string")
        df.select(F.timestamp_seconds(60 * F.col("m") + 600_000).alias("ts"), "session", "path").coalesce(1).write.parquet(f"{folder}/in/{i}")
        stream = spark.readStream.schema("ts timestamp, session string, path string").option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        for _ in range(2):  # started again without anything new
            S.ended(stream, "20 minutes", "10 minutes").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(S.ENDED).parquet(f"{folder}/out")
    got = sorted((r["session"], r["a"], r["b"], r["reason"], r["edits"], tuple(r["paths"])) for r in out.withColumn("a", F.unix_seconds("started") / 60 - 10_000).withColumn("b", F.unix_seconds("ended") / 60 - 10_000).collect())
    assert got == [("s", 0, 9, "stop", 3, ("a.md", "b.md", "late.md")), ("t", 3, 3, "gap", 1, ("a.md",)), ("t", 50, 50, "gap", 1, ("c.md",)), ("u", 200, 200, "gap", 1, ("d.md",))]
    pages = spark.createDataFrame([("a.md", "[x](/gone.md)"), ("d.md", "[x](/gone.md)"), ("z.md", "[x](/gone.md)")], "path string, content string")
    found = S.findings(out, pages, C.corpus_of(pages.limit(0)), pages.select("path"), mesh=False).where("kind = 'broken_link'")
    assert sorted((r["session"], r["file"]) for r in found.collect()) == [("s", "a.md"), ("t", "a.md"), ("u", "d.md")]
