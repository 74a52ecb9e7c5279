"""Tables written to the folder that driver and executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``.  A lost
executor then costs a reread of files, never a recomputation of the corpus.
A table goes as soon as all that was made of it is written too.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where it is unset and the session is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="inkgraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Bytes of an Arrow batch between Spark and Python at most (or one row), and rows that a scan decodes at once.
BATCH_BYTES, SCAN_ROWS = 4 << 20, 512
#: Bytes that a writer of an intermediate table gathers before it writes them, and of a page, which is read in one piece.
GROUP_BYTES, PAGE_BYTES = 16 << 20, 256 << 10
#: Bytes that a reader of Parquet takes in one piece: the JVM keeps larger pieces apart and frees them late.
READ = {"parquet.read.allocation.size": str(256 << 10)}
#: Rows of narrow tables that one file should have at least.
FILE_ROWS = 500_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of Arrow batches and of rows decoded at once, which bounds what a task holds of long texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(name).rstrip("bB"))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    name = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(name)) > SCAN_ROWS:
        spark.conf.set(name, str(SCAN_ROWS))


def written(df: DataFrame, name: str, rows: int | None = None, by: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back; with ``by`` in a folder for each value of that column.

    ``rows`` bounds the rows of a narrow table, which is then dealt to files of FILE_ROWS rows at least.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(rows // FILE_ROWS + 1)
    writer = df.write.option("parquet.block.size", GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.options(**READ).schema(df.schema).parquet(path)
    out.written_path = path
    if scopes := _scopes():
        scopes[-1].append(out)
    return out


_local = threading.local()


def _scopes() -> list[list[DataFrame]]:
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


def _delete(table: DataFrame, part: str = "") -> None:
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_path + part)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles of jobs that ended now, not only when the driver is short of memory."""
    gc.collect()
    spark._jvm.System.gc()


def drop(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` of which everything that is still needed has been written."""
    for table in tables:
        _delete(table)
        for scope in _scopes():
            scope[:] = [x for x in scope if x is not table]
    if tables:
        sweep(tables[0].sparkSession)


def drop_part(table: DataFrame, by: str, value: int) -> None:
    """Deletes the rows of one value of the column that ``table`` was written by; they must not be read again."""
    _delete(table, f"/{by}={value}")
    sweep(table.sparkSession)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes all tables written inside it at its end, but for those given to what it yields."""
    scopes = _scopes()
    own: list[DataFrame] = []
    scopes.append(own)

    def kept(table: DataFrame) -> DataFrame:
        own[:] = [x for x in own if x is not table]
        if len(scopes) > 1:
            scopes[-2].append(table)
        return table

    try:
        yield kept
    finally:
        scopes.remove(own)
        for table in own:
            _delete(table)
        if own:
            sweep(own[0].sparkSession)
