"""Sessions of edits as a stream: a session ends with its stop event or after a gap, is emitted once, and is checked then.

State holds the events that are not settled yet.  Event time settles them: when the watermark has
passed a stop, or a gap after the last edit, nothing can come that would belong before it, so what is emitted does
not depend on how events were dealt to batches.  Events behind the watermark are late and are dropped by Spark.
Sessions are dealt to buckets by their ids, and the events of a bucket are one state and are settled together, so
work grows with events and not with calls for each id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import check

ENDED = "session string, started timestamp, ended timestamp, reason string, edits long, paths array<string>"
STATE = "events binary"
EVENTS = pa.schema([("session", pa.string()), ("ms", pa.int64()), ("path", pa.string())])
#: Buckets of sessions; those of a checkpoint are kept.
BUCKETS = 256


def settle(events: pd.DataFrame, gap: int, watermark: int) -> tuple[pd.DataFrame, pd.DataFrame, int | None]:
    """(sessions that are over, events that are left, when the next one may be over) of events (session, ms, path) of any sessions; a stop has no path.

    Times are in milliseconds.  A stop with no edit before it is no session.
    """
    code, ms, stop = pd.factorize(events["session"])[0], events["ms"].to_numpy(np.int64), events["path"].isna().to_numpy()
    order = np.lexsort((stop, ms, code))
    code, ms, stop = code[order], ms[order], stop[order]
    session, path = (events[c].to_numpy(object)[order] for c in ("session", "path"))
    opens = np.ones(len(order), bool)
    opens[1:] = (code[1:] != code[:-1]) | stop[:-1] | (ms[1:] - ms[:-1] > gap)
    first = np.flatnonzero(opens)
    size = np.diff(np.append(first, len(order)))
    last = first + size - 1
    at = ms[last] + np.where(stop[last], 0, gap)
    done, edits = at <= watermark, size - stop[last]
    a, b, n = (x[done & (edits > 0)] for x in (first, last, edits))
    paths = pd.Series([path[i : i + k].tolist() for i, k in zip(a, n, strict=True)], dtype=object)
    over = pd.DataFrame({"session": session[a], "started": ms[a], "ended": ms[b], "reason": np.where(stop[b], "stop", "gap"), "edits": n.astype(np.int64), "paths": paths})
    kept = np.repeat(~done, size)
    left = pd.DataFrame({"session": session[kept], "ms": ms[kept], "path": path[kept]})
    return over, left, None if done.all() else int(at[~done].min())


def settled(events: list[tuple[int, str | None]], gap: int, watermark: int) -> tuple[list[tuple[int, int, str, list[str]]], list[tuple[int, str | None]], int | None]:
    """The same for the events (ms, path) of one session."""
    frame = pd.DataFrame({"session": "", "ms": [t for t, _ in events], "path": pd.Series([p for _, p in events], dtype=object)})
    over, left, at = settle(frame, gap, watermark)
    return list(zip(over["started"].tolist(), over["ended"].tolist(), over["reason"], over["paths"], strict=True)), list(zip(left["ms"].tolist(), left["path"], strict=True)), at


def _packed(events: pd.DataFrame) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, EVENTS) as stream:
        stream.write_table(pa.Table.from_pandas(events, EVENTS, preserve_index=False))
    return out.getvalue().to_pybytes()


def ended(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """(session, started, ended, reason, edits, paths) of a stream of events (ts, session, path; null path: stop)."""
    gap_ms = int(pd.Timedelta(gap).total_seconds() * 1000)

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = [pa.ipc.open_stream(state.get[0]).read_pandas()] if state.exists else []
        for frame in frames:
            if not state.hasTimedOut:
                known.append(frame[EVENTS.names])
        over, left, at = settle(pd.concat(known, ignore_index=True), gap_ms, state.getCurrentWatermarkMs())
        if len(over):
            times = {c: pd.to_datetime(over[c], unit="ms") for c in ("started", "ended")}
            yield over.assign(**times, paths=[sorted(set(p)) for p in over["paths"]])
        if len(left):
            state.update((_packed(left),))
            state.setTimeoutTimestamp(at)
        elif state.exists:
            state.remove()

    rows = events.where("ts is not null").withWatermark("ts", delay).select("ts", F.col("session").cast("string").alias("session"), "path", F.unix_millis("ts").alias("ms"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("session"), F.lit(buckets)))
    return rows.groupBy("bucket").applyInPandasWithState(advance, ENDED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def findings(sessions: DataFrame, pages: DataFrame, corpus: DataFrame, paths: DataFrame, **options) -> DataFrame:
    """(session, started, kind, file, line, message) for the pages that ended sessions (a batch) edited and that are there."""
    edited = sessions.select("session", "started", F.explode("paths").alias("file"))
    scope = edited.select(F.col("file").alias("path")).distinct().join(pages.select("path"), "path", "left_semi")
    found = check.check(pages, corpus, paths, scope=scope, **options)
    return edited.join(found, "file").select("session", "started", "kind", "file", "line", "message")
