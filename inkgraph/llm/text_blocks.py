"""Texts in numbered blocks, and a question-and-answer shuffle between blocks and shards.

Operators that need a corpus-wide fact about each of a text's many pieces (how
often a shingle occurs, whether an anchor is shared) do not join rows.  A block
sends its distinct pieces, packed, to the shards of their hashes; a shard
answers each block in the order in which it was asked.  A piece in a third of
all texts is then one entry for each block, not one for each text.

The blocks are a written table, so their numbers and contents are the same
whenever they are read again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .buffers import blocks, text_buffer, trim
from .storage import small_batches, written

BLOCK = 1 << 20
#: Least shards of a question, and the blocks whose pieces a shard gets at most, about: as texts grow, shards do.
SHARDS, SHARD_BLOCKS = 64, 32

SCHEMA = "block long, ids array<long>, ends binary, text binary"


def pack(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def unpack(x: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


def pack_deltas(x: np.ndarray) -> bytes:
    """Numbers by their differences, byte place by byte place."""
    planes = np.diff(x.astype(np.int32), prepend=np.int32(0)).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_deltas(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.int32), dtype=np.int64)


def shard_count(texts: DataFrame, blocks: int = SHARD_BLOCKS) -> int:
    """Shards for the pieces of a table of blocks: each gets those of ``blocks`` blocks of text, about."""
    return max(SHARDS, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-texts.count() // blocks))


def text_blocks(docs: DataFrame) -> DataFrame:
    """The written table of blocks of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in blocks(batches, limit=BLOCK):
            data, ends = text_buffer(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()),
                    pa.array([batch.column("doc_id").cast(pa.int64()).to_pylist()], pa.list_(pa.int64())),
                    pa.array([pack(ends)], pa.binary()),
                    pa.array([zstandard.ZstdCompressor(level=3).compress(data.tobytes())], pa.binary()),
                ],
                names=["block", "ids", "ends", "text"],
            )
            block += 1

    return written(docs.select("doc_id", "text").mapInArrow(run, SCHEMA), "blocks")


def read_blocks(batches: Iterator[pa.RecordBatch] | pa.Table) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    """(number, ids, bytes, offsets) of each block."""
    for batch in batches.to_batches() if isinstance(batches, pa.Table) else batches:
        for i in range(batch.num_rows):
            text = zstandard.ZstdDecompressor().decompress(batch.column("text")[i].as_py())
            yield batch.column("block")[i].as_py(), batch.column("ids")[i].as_py(), np.frombuffer(text, np.uint8), unpack(batch.column("ends")[i].as_py(), np.int64)
    if not isinstance(batches, pa.Table):  # a task is over, not a group of many
        trim()


def table(names: str, kinds: list, rows: list) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names.split(), kinds, strict=True))})


def batch(names: str, kinds: list, rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names.split())
