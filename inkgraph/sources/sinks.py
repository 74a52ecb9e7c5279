"""Sinks: results as JSON or text, logs, state and patched pages.

``write_tree`` and ``write_array`` stage their files in a hidden folder beside the target.  The commit renames that
folder, so a reader sees all of a result or nothing; a run that fails leaves no file.  The target's file system must
be one that the driver and all executors see and that renames folders.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def json_rows(results: DataFrame) -> DataFrame:
    """(value): each row as a JSON object, nulls left out."""
    return results.select(F.to_json(F.struct(*results.columns)).alias("value"))


def json_envelope(results: DataFrame, name: str) -> DataFrame:
    """(value): a small result as one object with its rows, in order, under ``name``; for findings and plans shown to a person."""
    rows = F.sort_array(F.collect_list(F.struct(*results.columns)))
    return results.groupBy().agg(F.to_json(F.struct(rows.alias(name))).alias("value"))


def result_text(results: DataFrame) -> DataFrame:
    """(position, value): search results as text: title, file, summary and snippets."""
    lines = F.array_join(F.transform("snippets", lambda s: F.concat(F.lit("  "), s["line"].cast("string"), F.lit(": "), s["text"])), "\n")
    head = F.concat(F.lit("# "), F.col("title"), F.lit("\n"), F.col("file"), F.lit("\n"), F.col("summary"))
    return results.select("position", F.when(F.size("snippets") > 0, F.concat(head, F.lit("\n"), lines)).otherwise(head).alias("value"))


def write_state(path: str, corpus: DataFrame, revision: str, source: str, strategy: int) -> None:
    """Replaces the one-row state table."""
    row = corpus.sparkSession.range(1).select(F.lit(revision).alias("revision"), F.lit(source).alias("source"), F.lit(strategy).alias("strategy"))
    row.write.mode("overwrite").parquet(path)


def append_log(path: str, events: DataFrame) -> None:
    """Adds log events as JSON lines."""
    events.write.mode("append").json(path)


def write_pages(path: str, pages: DataFrame) -> None:
    """Patched pages (path, content) as a table; the originals are never changed in place."""
    pages.write.mode("overwrite").parquet(path)


#: Names of drafts in a tree: a page is written under one and then renamed, so only a lost attempt leaves one.
DRAFT = r"\.draft-[0-9a-f]{32}-[0-9]+"


def _located(path: str) -> tuple[fs.FileSystem, str]:
    scheme, colon, rest = path.partition(":")
    plain = colon and scheme == "file"
    system, name = fs.FileSystem.from_uri("/" + rest.lstrip("/") if plain else path)
    return system, name.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    """What the attempt that counts has written: its part, the file of the part, and its rows."""

    part: int
    file: str
    rows: int


class StagedWriter(DataSourceArrowWriter):
    """Files go to a staging folder; the commit makes it the target by one rename."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        system, name = _located(path)
        if not overwrite and system.get_file_info(name).type != fs.FileType.NotFound:
            raise FileExistsError(path)
        self.staging = posixpath.join(posixpath.dirname(name), f".{posixpath.basename(name)}-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        return self.write_part(_located(self.path)[0], context.partitionId(), context.taskAttemptId(), iterator)

    def write_part(self, system: fs.FileSystem, part: int, attempt: int, batches: Iterator[pa.RecordBatch]) -> Written:
        raise NotImplementedError

    def complete(self, system: fs.FileSystem, parts: list[Written]) -> None:
        """Last work on the staging folder, given the parts in order."""

    def commit(self, messages: list[Written | None]) -> None:
        system, name = _located(self.path)
        system.create_dir(self.staging)
        self.complete(system, sorted((m for m in messages if m), key=lambda m: m.part))
        old = f"{self.staging}-old"
        replaced = self.overwrite and system.get_file_info(name).type != fs.FileType.NotFound
        if replaced:
            system.move(name, old)
        system.move(self.staging, name)
        if replaced:
            system.delete_dir(old)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _located(self.path)
        if system.get_file_info(self.staging).type != fs.FileType.NotFound:
            system.delete_dir(self.staging)


class TreeWriter(StagedWriter):
    """One file a page.  An attempt writes beside a page's name and renames, so attempts that run at once do not mix."""

    def write_part(self, system: fs.FileSystem, part: int, attempt: int, batches: Iterator[pa.RecordBatch]) -> Written:
        rows, made, draft = 0, "", f".draft-{self.staging[-32:]}-{attempt}"
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if not path or path.startswith("/") or {"", ".", ".."} & set(path.split("/")):
                    raise ValueError(f"no path below the folder: {path!r}")
                name = posixpath.join(self.staging, path)
                folder = posixpath.dirname(name)
                if folder != made:
                    system.create_dir(folder)
                    made = folder
                with system.open_output_stream(posixpath.join(folder, draft)) as f:
                    f.write((content or "").encode())
                system.move(posixpath.join(folder, draft), name)
                rows += 1
        return Written(part, "", rows)


class ArrayWriter(StagedWriter):
    """Parts of one JSON array, a row a line; the commit adds what stands between them."""

    def write_part(self, system: fs.FileSystem, part: int, attempt: int, batches: Iterator[pa.RecordBatch]) -> Written:
        name, rows = f"{part:08d}-{attempt}.json", 0
        system.create_dir(self.staging)
        with system.open_output_stream(posixpath.join(self.staging, name)) as f:
            for batch in batches:
                for value in batch.column("value").to_pylist():
                    f.write(((",\n" if rows else "") + value).encode())
                    rows += 1
        return Written(part, name, rows)

    def complete(self, system: fs.FileSystem, parts: list[Written]) -> None:
        full = [m for m in parts if m.rows]
        kept = {m.file for m in full}
        for info in system.get_file_info(fs.FileSelector(self.staging)):
            if info.base_name not in kept:  # empty parts, and attempts that do not count
                system.delete_file(info.path)
        glue = {"-head.json": "[\n", "~tail.json": "\n]\n"} | {f"{m.part:08d}~.json": ",\n" for m in full[:-1]}
        for name, text in glue.items():  # "-" sorts before, "~" behind all digits
            with system.open_output_stream(posixpath.join(self.staging, name)) as f:
                f.write(text.encode())


class PageTree(DataSource):
    """Sink of (path, content): a folder with one file a page."""

    @classmethod
    def name(cls) -> str:
        return "page_tree"

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"], overwrite)


class JsonArray(DataSource):
    """Sink of (value): a folder whose files, in order of their names, are one JSON array."""

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageTree)
    spark.dataSource.register(JsonArray)


def write_tree(path: str, pages: DataFrame, overwrite: bool = False) -> None:
    """A folder with a file for each of ``pages`` (path, content), all at once.

    Null content is an empty file.  Paths that stand twice, are empty, absolute or lead out of the folder are errors, as
    are those with empty parts or dots (``a//b``, ``./a``), since another path may name the same file.  An existing
    folder is an error unless ``overwrite`` replaces it as a whole.
    """
    register(pages.sparkSession)
    twice = pages.groupBy("path").count().where("count > 1").orderBy("path").first()
    if twice:
        raise ValueError(f"{twice['count']} pages have the path {twice['path']!r}")
    pages.select("path", "content").write.format("page_tree").mode("overwrite" if overwrite else "append").save(path)


def write_array(path: str, results: DataFrame, order: list[str], overwrite: bool = False) -> None:
    """A folder of parts that, one after the other in order of their names, are one JSON array of all rows by ``order``.

    Rows that ``order`` does not tell apart stand in order of their JSON; a result without rows is an empty array.
    Parts are sorted ranges, so no task or driver holds more than its range.
    """
    register(results.sparkSession)
    rows = results.withColumn("value", F.to_json(F.struct(*results.columns))).orderBy(*order, "value").select("value")
    rows.write.format("json_array").mode("overwrite" if overwrite else "append").save(path)


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(position, row) of an array that ``write_array`` has written, from 0; ``schema`` is that of a row."""
    parts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value").where("file rlike '^[0-9]+-'")
    rows = parts.select("file", F.posexplode(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), f"array<struct<{schema}>>")).alias("i", "row"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each part
    first = rows.groupBy("file").agg(F.count("*").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return rows.join(first, "file").select((F.col("first") + F.col("i")).alias("position"), "row")
