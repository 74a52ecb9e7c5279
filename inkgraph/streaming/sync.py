"""Corpus sync as a stream: versions of pages arrive as files, each batch is merged by path.

Sync is a diff of contents, so the stream keeps no state but its checkpoint; a
repeated or late version changes nothing, as the newest of each path wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import index, sync
from ..sources import corpus as C

SCHEMA = "path string, content string, mtime_ns long, deleted boolean"


def current(spark: SparkSession, target: str) -> DataFrame:
    """The corpus as of the last merged batch: path, content, mtime_ns, content_hash, deleted."""
    versions = spark.read.parquet(target)
    return sync.latest(versions.drop("batch"))


def start(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Merges all files of versions that are there and ends; started again it goes on where it was.

    A batch appends only versions that differ from what is known of their paths, under its number, so
    a batch that is run twice after a failure replaces itself.
    """
    incoming = spark.readStream.schema(SCHEMA).json(source)

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.select("path", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("mtime_ns", F.lit(0)).alias("mtime_ns"), F.coalesce("deleted", F.lit(False)).alias("deleted"))
        rows = sync.latest(rows.withColumn("content_hash", F.sha2("content", 256)))
        try:
            known = current(spark, target).select("path", F.col("mtime_ns").alias("old_time"), F.col("content_hash").alias("old_hash"), F.col("deleted").alias("old_deleted"))
        except Exception as e:  # no batch was written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = None
        if known is not None:
            same = F.col("old_hash").eqNullSafe(F.col("content_hash")) & F.col("old_deleted").eqNullSafe(F.col("deleted"))
            rows = rows.join(known, "path", "left").where((F.col("old_time").isNull() | (F.col("old_time") <= F.col("mtime_ns"))) & ~same).select(*rows.columns)
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return incoming.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_indexed(spark: SparkSession, source: str, path: str, checkpoint: str) -> StreamingQuery:
    """The same into a stored search index: each batch is one update of it, and no text that is there is read again.

    Batches are taken in their order, and of a path in a batch the newest version counts.  A page that lost its
    membership goes, like a deleted one.  A batch that is run twice finds its pages unchanged and writes nothing.
    """
    incoming = spark.readStream.schema(SCHEMA).json(source)

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.select("path", "content", F.coalesce("mtime_ns", F.lit(0)).alias("mtime_ns"), F.coalesce("deleted", F.lit(False)).alias("deleted"))
        rows = sync.latest(rows.withColumn("content_hash", F.sha2("content", 256)))
        members = C.corpus_of(rows.where("not deleted").select("path", "content"))
        gone = rows.select(F.col("path").alias("path_rel")).join(members.select("path_rel"), "path_rel", "left_anti")
        index.update(batch.sparkSession, path, members, deleted=gone)

    return incoming.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def edited_pages(events: DataFrame) -> DataFrame:
    """Distinct (session, path) of edit events (ts, session, value: JSON) within a day, as a stream with bounded state."""
    path = F.get_json_object("value", "$.tool_input.file_path")
    return events.select("ts", "session", path.alias("path")).where("path is not null").withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["session", "path"])
