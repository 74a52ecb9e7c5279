"""A change feed of leaderboards: the best-selling items of each nation after each day of arrival.

Sale lines are cut into batches by their day of arrival and fed one after the
other to a stateful streaming query, which is started anew for each batch on
one checkpoint.  Its event time is the day of arrival.  A key of the state is a
nation and a shard of its items, so that a nation with a third of all lines is
spread over many tasks; shards get more as lines do.  A key holds accepted
deltas by day of arrival, the revenue of its items, and its own board.  A timer
stands at the end of its first open day; when the watermark has passed it, all
days that ended are folded in ascending order and changes of the key's board are
emitted.  A sentinel after the last batch moves the watermark past the last days.

A nation's board is the best of the boards of its shards: ten of each day and
shard are enough to know the ten of the nation.  They are merged in windows by
nation and day, and a day's board is compared with the one before it.

Nulls: a line without shipped_at gets a day from its hash, without amount the
price of its item counts, without both nothing; NaN and infinite numbers are as
null.  Lines without vendor, nation or item only count for the largest day.
Rows that occur twice count twice.  If a vendor or item has several rows, its
nation is the smallest and its price the highest one.  Empty tables give no rows.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .storage import shared_dir

TOP, GRACE_DAYS, BATCHES = 10, 15, 8
#: The first day and the number of days over which batches are dealt.
FIRST_DAY, DAYS = 19723, 180
#: There is a shard of each nation's items for so many lines.
SHARD_LINES = 1 << 19
#: Rows that are summed at a time before they are shuffled.
COMBINE_ROWS = 1 << 17

#: A day is a second of event time: all days of the calendar fit into the nanoseconds of pandas then.
DAY_MS = 1000
#: Day of the sentinel, in the year 9999.
SENTINEL_DAY = 2_932_000
NO_DAY = -(1 << 40)
#: Its vendor and item.
NO_ID = -(1 << 63)

LINE = "item_id long, vendor_id long, quantity int, amount double, flag string, ship_day long, arrival_day long, batch int"
STATE = "items binary, cents binary, board_items binary, board_cents binary, days binary, day_items binary, day_cents binary"
EMITTED = "nation_id int, shard int, arrival_day long, item_id long, revenue long, on_board boolean"


def _number(c: str) -> Column:
    """Null where it is no finite number."""
    return F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))


def batch_of(day: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(BATCHES), 1 + F.floor((day - FIRST_DAY) * BATCHES / DAYS))).cast("int")


def cut(lines: DataFrame) -> DataFrame:
    """Lines with their days of shipping and arrival and their batch."""
    h = F.crc32(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sale_id", "item_id", "vendor_id", "line_no")]))
    ship = F.coalesce(F.unix_date(F.col("shipped_at").cast("date")).cast("long"), FIRST_DAY + F.col("h") % 150)
    arrival = F.col("ship_day") + F.col("h") % 7 + F.when(F.col("h") % 5 == 0, 20).otherwise(0)
    rows = lines.withColumn("h", h).withColumn("ship_day", ship).withColumn("arrival_day", arrival).withColumn("batch", batch_of(F.col("arrival_day")))
    return rows.select(F.col("item_id").cast("long").alias("item_id"), F.col("vendor_id").cast("long").alias("vendor_id"), F.col("quantity").cast("int").alias("quantity"), _number("amount").alias("amount"), "flag", "ship_day", "arrival_day", "batch")


# The state of a key: sorted items and their revenue, its board, and deltas of open days by (day, item).


def pack(x: np.ndarray) -> bytes:
    """Numbers of eight bytes, byte place by byte place."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(x: bytes, kind: type = np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def summed(keys: list[np.ndarray], cents: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct keys and the sum of each."""
    order = np.lexsort(keys[::-1])
    keys, cents = [k[order] for k in keys], cents[order]
    if not len(cents):
        return keys, cents
    first = np.ones(len(cents), bool)
    first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return [k[first] for k in keys], np.add.reduceat(cents, np.flatnonzero(first))


def best(items: np.ndarray, cents: np.ndarray) -> np.ndarray:
    """Places of the TOP highest positive revenues, the smaller item first where they are equal."""
    places = np.flatnonzero(cents > 0)
    if len(places) > TOP:
        least = np.partition(cents[places], len(places) - TOP)[len(places) - TOP]
        places = places[cents[places] >= least]
    return places[np.lexsort((items[places], -cents[places]))][:TOP]


class Shard:
    """What one key of the state knows."""

    def __init__(self, state: tuple | None):
        if state is None:
            self.items, self.board_items, self.days, self.day_items = (np.zeros(0, np.int64) for _ in range(4))
            self.cents, self.board_cents, self.day_cents = (np.zeros(0) for _ in range(3))
        else:
            items, cents, board_items, board_cents, days, day_items, day_cents = state
            self.items, self.board_items, self.days, self.day_items = np.cumsum(unpack(items)), unpack(board_items), np.cumsum(unpack(days)), unpack(day_items)
            self.cents, self.board_cents, self.day_cents = unpack(cents, np.float64), unpack(board_cents, np.float64), unpack(day_cents, np.float64)

    def packed(self) -> tuple:
        steps = lambda x: pack(np.diff(x, prepend=np.int64(0)))
        return steps(self.items), pack(self.cents), pack(self.board_items), pack(self.board_cents), steps(self.days), pack(self.day_items), pack(self.day_cents)

    def buffer(self, days: np.ndarray, items: np.ndarray, cents: np.ndarray) -> None:
        (self.days, self.day_items), self.day_cents = summed([np.concatenate([self.days, days]), np.concatenate([self.day_items, items])], np.concatenate([self.day_cents, cents]))

    def timer(self) -> int | None:
        """The end of the first open day, in milliseconds."""
        return int(self.days[0] + 1) * DAY_MS - 1 if len(self.days) else None

    def fold(self, watermark: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Folds the days that end before the watermark, ascending: (day, items, revenues, which are on the board) where the board changes."""
        over = int(np.searchsorted(self.days, watermark // DAY_MS))
        if not over:
            return
        days, day_items, day_cents = self.days[:over], self.day_items[:over], self.day_cents[:over]
        self.days, self.day_items, self.day_cents = self.days[over:], self.day_items[over:], self.day_cents[over:]
        everything = np.union1d(self.items, day_items)
        cents = np.zeros(len(everything))
        cents[np.searchsorted(everything, self.items)] = self.cents
        self.items, self.cents = everything, cents
        starts = np.flatnonzero(np.diff(days, prepend=np.int64(NO_DAY)))
        for start, end in zip(starts, [*starts[1:], over], strict=True):
            cents[np.searchsorted(everything, day_items[start:end])] += day_cents[start:end]
            top = best(everything, cents)
            if np.array_equal(everything[top], self.board_items) and np.array_equal(cents[top], self.board_cents):
                continue
            left = np.searchsorted(everything, np.setdiff1d(self.board_items, everything[top]))
            self.board_items, self.board_cents = everything[top], cents[top]
            both = np.concatenate([top, left])
            yield int(days[start]), everything[both], cents[both], np.arange(len(both)) < len(top)


def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Folds a key's ended days when its timer fires, or, if new deltas come at that moment, before they are buffered.

    The sentinel has no nation and leaves no state.
    """
    if key[0] is None or key[0] != key[0]:
        return
    shard = Shard(state.get if state.exists else None)
    for day, items, cents, on in shard.fold(state.getCurrentWatermarkMs()):
        yield pd.DataFrame({"nation_id": np.int32(key[0]), "shard": np.int32(key[1]), "arrival_day": day, "item_id": items, "revenue": cents.astype(np.int64), "on_board": on})
    if not state.hasTimedOut:
        for frame in frames:
            shard.buffer(frame["arrival_day"].to_numpy(np.int64), frame["item_id"].to_numpy(np.int64), frame["cents"].to_numpy(np.float64))
    state.update(shard.packed())
    if (at := shard.timer()) is not None:
        state.setTimeoutTimestamp(at)


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of (nation, shard, item, day) over some rows at a time: a hot item is a row for each of its days then."""
    keys = ["nation_id", "shard", "item_id", "arrival_day"]
    held, rows = [], 0

    def total() -> list[pa.RecordBatch]:
        return pa.Table.from_batches(held).group_by(keys).aggregate([("cents", "sum")]).rename_columns([*keys, "cents"]).to_batches()

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= COMBINE_ROWS:
            yield from total()
            held, rows = [], 0
    if rows:
        yield from total()


def _looked_up(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``table``, null where it has no such key.

    Keys of many rows are looked up in ``hot``, which has a row for each task at most, and are dealt at random then.
    """
    columns = [c for c in table.columns if c != key]
    rows = rows.join(F.broadcast(hot.select(key, *[F.col(c).alias(f"hot_{c}") for c in columns], F.lit(True).alias("hot"))), key, "left")
    rows = rows.withColumn("dealt", F.when(F.col("hot"), -1 - F.abs(F.xxhash64("item_id", "vendor_id", "amount", "ship_day"))).otherwise(F.col(key)))
    rows = rows.join(table.withColumnRenamed(key, "dealt").hint("merge"), "dealt", "left")
    for c in columns:
        rows = rows.withColumn(c, F.when(F.col("hot"), F.col(f"hot_{c}")).otherwise(F.col(c))).drop(f"hot_{c}")
    return rows.drop("hot", "dealt")


def _hot(rows: DataFrame, table: DataFrame, key: str, lines: int, tasks: int) -> DataFrame:
    """Rows of ``table`` whose key has more lines than a task's share, thus fewer than tasks."""
    found = rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > lines / tasks).select(key)
    return table.join(F.broadcast(found), key)


def deltas(rows: DataFrame, vendors: DataFrame, items: DataFrame, hot_vendors: DataFrame, hot_items: DataFrame, shards: int) -> DataFrame:
    """(nation_id, shard, item_id, arrival_day, cents) of the lines that have a nation and an item, and of the sentinel without a nation."""
    end = F.col("arrival_day") == SENTINEL_DAY
    rows = rows.where(F.col("vendor_id").isNotNull() & F.col("item_id").isNotNull())
    rows = _looked_up(rows, vendors, "vendor_id", hot_vendors).where(F.col("nation_id").isNotNull() | end)
    rows = _looked_up(rows, items, "item_id", hot_items).where(F.col("known") | end)
    cents = F.coalesce(F.floor(100 * F.col("amount") + 0.5).cast("double"), F.col("quantity") * F.floor(100 * F.col("price") + 0.5).cast("double"), F.lit(0.0))
    cents = F.when(F.col("flag") == "swapped", -cents).otherwise(cents)
    rows = rows.select("nation_id", F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int").alias("shard"), "item_id", "arrival_day", cents.alias("cents"))
    return rows.mapInArrow(combine, rows.schema)


def merged_boards(emitted: DataFrame) -> DataFrame:
    """(nation_id, arrival_day, item_id, old_rank, new_rank, revenue) of every change of a nation's board, from what its shards emitted.

    A shard's board holds from its day to the next one that the shard emitted.
    """
    day = ["nation_id", "arrival_day"]
    boards = emitted.groupBy("nation_id", "shard", "arrival_day").agg(F.collect_list(F.when(F.col("on_board"), F.struct("item_id", "revenue"))).alias("board"))
    boards = boards.withColumn("until", F.lead("arrival_day").over(Window.partitionBy("nation_id", "shard").orderBy("arrival_day"))).withColumnRenamed("arrival_day", "since")
    days = emitted.select(day).distinct()
    following = days.withColumn("next", F.lead("arrival_day").over(Window.partitionBy("nation_id").orderBy("arrival_day")))
    live = boards.join(days, "nation_id").where((F.col("arrival_day") >= F.col("since")) & (F.col("until").isNull() | (F.col("arrival_day") < F.col("until"))))
    live = live.select(*day, F.inline("board"))
    top = live.withColumn("new_rank", F.row_number().over(Window.partitionBy(day).orderBy(F.desc("revenue"), "item_id"))).where(F.col("new_rank") <= TOP)
    before = top.join(following, day).where(F.col("next").isNotNull()).select("nation_id", F.col("next").alias("arrival_day"), "item_id", F.col("new_rank").alias("old_rank"))
    key = [*day, "item_id"]
    diff = top.drop("revenue").join(before, key, "full_outer").where(~F.col("new_rank").eqNullSafe(F.col("old_rank")))
    known = live.unionByName(emitted.where(~F.col("on_board")).select(*key, "revenue"))  # an item that leaves a nation's board may also leave its shard's
    return diff.join(known, key)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings (dots written as two underscores) that hold inside and are as before afterwards."""
    values = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def change_feed(lines: DataFrame, vendors: DataFrame, items: DataFrame) -> DataFrame:
    """(nation_id, arrival_day, item_id, batch, change, old_rank, new_rank, revenue) of every change of a nation's board."""
    spark = lines.sparkSession
    folder = f"{shared_dir(spark)}/leaderboard-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def kept(table: DataFrame, name: str) -> DataFrame:
        table.write.parquet(f"{folder}/{name}")
        return spark.read.schema(table.schema).parquet(f"{folder}/{name}")

    cut(lines).write.partitionBy("batch").parquet(f"{folder}/cut")
    rows = spark.read.schema(LINE).parquet(f"{folder}/cut")
    found = {r["batch"]: r for r in rows.groupBy("batch").agg(F.max("ship_day").alias("day"), F.count("*").alias("n")).collect()}  # a row for each batch
    count, tasks = sum(r["n"] for r in found.values()), int(spark.conf.get("spark.sql.shuffle.partitions"))
    vendors = kept(vendors.groupBy(F.col("vendor_id").cast("long").alias("vendor_id")).agg(F.min("nation_id").cast("int").alias("nation_id")), "vendors")
    items = kept(items.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.max(_number("price")).alias("price"), F.lit(True).alias("known")), "items")
    hot = [kept(_hot(rows, table, key, count, tasks), f"hot_{key}") for key, table in (("vendor_id", vendors), ("item_id", items))]
    shards = -(-count // SHARD_LINES) or 1
    sentinel = {"item_id": NO_ID, "vendor_id": NO_ID, "ship_day": SENTINEL_DAY, "arrival_day": SENTINEL_DAY, "batch": BATCHES + 1}
    types = dict(f.split() for f in LINE.split(", "))
    spark.range(1).select(*[F.lit(sentinel.get(c)).cast(t).alias(c) for c, t in types.items()]).write.partitionBy("batch").parquet(f"{folder}/end")

    fs.mkdirs(path(f"{folder}/fed"))
    fs.mkdirs(path(f"{folder}/emitted"))
    largest = None
    for batch in [*sorted(found), BATCHES + 1]:
        fs.rename(path(f"{folder}/{'cut' if batch in found else 'end'}/batch={batch}"), path(f"{folder}/fed/batch={batch}"))
        stream = spark.readStream.schema(LINE).parquet(f"{folder}/fed")
        if largest is not None:
            stream = stream.where(F.col("ship_day") + GRACE_DAYS >= largest)
        changes = deltas(stream, vendors, items, *hot, shards).withColumn("arrived", F.timestamp_seconds("arrival_day")).withWatermark("arrived", "0 seconds")
        boards = changes.groupBy("nation_id", "shard").applyInPandasWithState(advance, EMITTED, STATE, "append", GroupStateTimeout.EventTimeTimeout)
        with settings(spark, spark__sql__streaming__minBatchesToRetain="2", spark__sql__streaming__noDataMicroBatches__enabled=str(batch > BATCHES).lower()):  # a batch's last timers fire with the next batch, the sentinel's after it
            query = boards.writeStream.format("parquet").option("path", f"{folder}/emitted").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
        if batch in found:
            largest = found[batch]["day"] if largest is None else max(largest, found[batch]["day"])
            fs.delete(path(f"{folder}/fed/batch={batch}"), True)
    changes = kept(merged_boards(spark.read.schema(EMITTED).parquet(f"{folder}/emitted")), "changes")
    for part in ("cut", "fed", "end", "vendors", "items", "hot_vendor_id", "hot_item_id", "checkpoint", "emitted"):
        fs.delete(path(f"{folder}/{part}"), True)
    change = F.when(F.col("old_rank").isNull(), "enter").when(F.col("new_rank").isNull(), "exit").otherwise("move")
    return changes.select("nation_id", "arrival_day", "item_id", batch_of(F.col("arrival_day")).alias("batch"), change.alias("change"), "old_rank", "new_rank", "revenue")
