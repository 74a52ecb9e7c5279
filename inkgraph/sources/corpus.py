"""Corpora: from pages with frontmatter, and a derived one over the driver's tables."""

from __future__ import annotations

import os
import re
import stat
from collections import deque
from collections.abc import Iterable, Iterator
from functools import partial, reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frontmatter as fm
from ..functions import text as T
from .sinks import DRAFT, _located
from .tables import written

#: Entries that a task lists before it leaves directories below to others; files and bytes of files that one task reads, about.
LISTED, TASK_FILES, TASK_BYTES = 1_000, 4_000, 64 << 20
#: Rows and bytes of content that a batch holds, about.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20
#: Partitions of Spark's scan of files that one task reads; Spark puts some 32 small files into a partition.
TASK_PARTS = 32
#: Schemes of file systems that rename folders and that Python reaches as Spark does.
RENAMING = ("file", "hdfs")
#: Names that are no pages: git's own folder, checksum files of Hadoop, and drafts of attempts that were lost.
NO_PAGE = re.compile(rf"\.git|\..*\.crc|{DRAFT}")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, mtime_ns, size_bytes) of all files below a folder that any Spark reader can reach.

    Folders of file systems on which ``write_tree`` commits are listed and read by tasks, hidden names among them; git's own
    folder and checksum files are left out.  In other stores Spark's reader lists the files, without hidden ones, in the driver.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop_fs = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    at = hadoop_fs.makeQualified(hadoop).toString()
    if at.partition(":")[0] in RENAMING and hadoop_fs.exists(hadoop) and hadoop_fs.getFileStatus(hadoop).isDirectory():
        files = _listed(spark, at).mapInArrow(partial(_contents, at), "path string, content binary, mtime_ns long, size_bytes long")
        return files.withColumn("content", F.decode("content", "UTF-8"))
    files = _gathered(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))
    base = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    rel = F.regexp_replace("path", r"^[a-z0-9+]+:/*", "")
    return files.select(F.regexp_replace(rel, "^" + _quoted(base) + "/", "").alias("path"), F.decode("content", "UTF-8").alias("content"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size_bytes"))


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, mtime_ns, size_bytes) of the files below a folder, dealt to as many tasks as are to read them."""
    cores, levels, files, size = spark.sparkContext.defaultParallelism, [], 0, 0
    todo, dirs = spark.range(1).select(F.lit("").alias("path")), 1
    while dirs:
        level = written(todo.repartition(min(dirs, 4 * cores)).mapInArrow(partial(_entries, folder), "path string, directory boolean, mtime_ns long, size_bytes long"), "listing")
        levels.append(level.where("not directory").drop("directory"))
        todo = level.where("directory").select("path")
        found = level.agg(F.count_if("directory"), F.count_if(~F.col("directory")), F.coalesce(F.sum("size_bytes"), F.lit(0))).first()
        dirs, files, size = found[0], files + found[1], size + found[2]
    tasks = max(4 * cores, -(-size // TASK_BYTES), -(-files // TASK_FILES))
    return reduce(DataFrame.union, levels).repartition(max(1, min(files, tasks)))


def _entries(folder: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files in the directories of ``batches`` and, while these are few, below; else the directories that are still to be listed."""
    system, top = _located(folder)
    todo = deque(path for batch in batches for path in batch.column("path").to_pylist())
    rows, given, seen = [], len(todo), 0
    while todo and (given > 0 or seen < LISTED):
        path, given = todo.popleft(), given - 1
        for name, is_dir, mtime, size in _children(system, f"{top}/{path}"):
            seen += 1
            if is_dir:
                todo.append(f"{path}{name}/")
            else:
                rows.append((f"{path}{name}", False, mtime, size))
            if len(rows) == BATCH_ROWS:
                yield _batch(rows)
                rows = []
    rows += [(path, True, 0, 0) for path in todo]
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], ["path", "directory", "mtime_ns", "size_bytes"])


def _children(system: fs.FileSystem, directory: str) -> Iterator[tuple[str, bool, int, int]]:
    """(name, is a directory, mtime_ns, size_bytes) of what may be or hold pages in a directory."""
    if isinstance(system, fs.LocalFileSystem):  # one by one, where others give a list
        with os.scandir(directory) as entries:
            for entry in entries:
                if NO_PAGE.fullmatch(entry.name) or entry.is_symlink() and not os.path.exists(entry.path):
                    continue
                s = entry.stat()
                if stat.S_ISDIR(s.st_mode) or stat.S_ISREG(s.st_mode):
                    yield entry.name, stat.S_ISDIR(s.st_mode), s.st_mtime_ns, s.st_size
        return
    for info in system.get_file_info(fs.FileSelector(directory)):
        if not NO_PAGE.fullmatch(info.base_name) and info.type in (fs.FileType.Directory, fs.FileType.File):
            yield info.base_name, info.type == fs.FileType.Directory, info.mtime_ns or 0, info.size or 0


def _contents(folder: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Listed files with their bytes, in batches of bounded size."""
    system, top = _located(folder)
    for batch in batches:
        paths, held, first, size = batch.column("path").to_pylist(), [], 0, 0
        for i, path in enumerate(paths):
            with system.open_input_stream(f"{top}/{path}", compression=None) as f:
                held.append(f.read())
            size += len(held[-1])
            if i + 1 == len(paths) or len(held) == BATCH_ROWS or size >= BATCH_BYTES:
                part = batch.slice(first, len(held))
                yield pa.RecordBatch.from_arrays([part.column("path"), pa.array(held, pa.binary()), part.column("mtime_ns"), part.column("size_bytes")], ["path", "content", "mtime_ns", "size_bytes"])
                held, first, size = [], i + 1, 0


def _gathered(files: DataFrame) -> DataFrame:
    """The rows of a scan of files in fewer tasks if most files are small, as Spark counts each as 4 MB."""
    spark, parts = files.sparkSession, files.rdd.getNumPartitions()
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of all files, as listed
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES), -(-parts // TASK_PARTS))
    return files.coalesce(tasks) if tasks < parts else files


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def default_discovery(pages: DataFrame) -> DataFrame:
    """Markdown files outside test fixtures."""
    return pages.where(F.col("path").endswith(".md") & ~F.contains("path", F.lit("/tests/fixtures/")))


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: ``*`` and ``?`` also match slashes, ``[...]`` and ``{a,b}`` are kept."""
    out, depth = "", 0
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            while i + 1 < len(pattern) and pattern[i + 1] == "*":
                i += 1
            if pattern[i + 1 : i + 2] == "/" and out.endswith(("/", "")) and pattern[i - 1 : i] == "*":
                out, i = out + "(?:.*/)?", i + 1
            else:
                out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            out, i = out + "[" + pattern[i + 1 : end].replace("!", "^", 1 if pattern[i + 1] == "!" else 0) + "]", end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += "\\" + c if c in r".+()|^$\{}" else c
        i += 1
    return "^" + out + "$"


def discover(pages: DataFrame, globs: list[str] | None = None) -> DataFrame:
    """Pages that any of the globs names, or those of the default discovery."""
    if not globs:
        return default_discovery(pages)
    hit = F.lit(False)
    for g in globs:
        hit = hit | F.col("path").rlike(glob_regex(g.removeprefix("./")))
    return pages.where(hit & F.col("path").endswith(".md"))


def corpus_of(pages: DataFrame) -> DataFrame:
    """Members among pages (path, content): path_rel, title, summary, aliases, tags, keywords, body, content, content_hash."""
    rows = pages.where("content is not null").withColumn("f", fm.parse_frontmatter("content")).where(fm.is_member(F.col("f")))
    return rows.select(F.col("path").alias("path_rel"), "f.title", "f.summary", "f.aliases", "f.tags", "f.keywords", fm.markdown_body("content").alias("body"), "content", F.sha2("content", 256).alias("content_hash"))


def links_of(links: DataFrame) -> DataFrame:
    """(source_file, source_line, target_path) of the internal links of ``markdown.links``."""
    return links.where("kind = 'internal'").select(F.col("path").alias("source_file"), "source_line", T.resolve_path("target", "path").alias("target_path"))


def documents_corpus(documents: DataFrame) -> DataFrame:
    """The derived corpus of ``documents``: the first line is the title, language and source are tags."""
    text = F.coalesce("text", F.lit(""))
    first = F.split(text, "\n", 2)
    rest = F.coalesce(F.get(first, F.lit(1)), F.lit(""))
    ident = F.col("doc_id").cast("string")
    return documents.select(
        F.concat(F.lit("wiki/"), "source", F.lit("/"), "lang", F.lit("/doc-"), ident, F.lit(".md")).alias("path_rel"),
        first[0].alias("title"),
        F.substring(rest, 1, 120).alias("summary"),
        F.array(F.concat(F.lit("d"), ident), F.concat("lang", F.lit("-"), (F.col("doc_id") % 97).cast("string"))).alias("aliases"),
        F.array("lang", "source").alias("tags"),
        F.array().cast("array<string>").alias("keywords"),
        text.alias("body"),
        text.alias("content"),
        F.sha2(text, 256).alias("content_hash"),
        "doc_id",
    )


def documents_links(documents: DataFrame) -> DataFrame:
    """Arithmetic links between the documents: each leads to ``7 * id + 3`` of as many, some to a page that is not there."""
    count = documents.agg(F.count("*").alias("n"))
    target = (F.col("doc_id") * 7 + 3) % F.col("n")
    path = lambda i: F.concat(F.lit("wiki/doc-"), i.cast("string"), F.lit(".md"))
    rows = documents.select("doc_id", "text").join(F.broadcast(count))  # a single row
    start = F.col("doc_id") % 40
    return rows.select(
        path(F.col("doc_id")).alias("path"),
        F.lit("internal").alias("kind"),
        F.concat(F.lit("/"), F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("gone/doc-"), target.cast("string"), F.lit(".md"))).otherwise(path(target))).alias("target"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("part-"), (F.col("doc_id") % 5).cast("string"))).alias("fragment"),
        F.when(F.col("doc_id") % 3 != 0, start.cast("int")).alias("start_line"),
        F.when(F.col("doc_id") % 3 != 0, (start + F.col("doc_id") % 7 - 2).cast("int")).alias("end_line"),
        (F.col("doc_id") % 9 + 1).cast("int").alias("source_line"),
        F.lit("").alias("href"),
    )


def documents_pages(documents: DataFrame) -> DataFrame:
    """(path, content): the documents as Markdown, every fifth line a heading of one of three levels, some named alike."""
    def line(x, i):
        level = F.repeat(F.lit("#"), (F.floor(i / 5) % 3 + 1).cast("int"))
        name = F.when(F.floor(i / 5) % 4 == 3, F.lit("Part 1")).otherwise(F.concat(F.lit("Part "), (F.floor(i / 5) % 5).cast("string")))
        return F.when(i % 5 == 0, F.concat(level, F.lit(" "), name)).otherwise(x)

    content = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line), "\n")
    return documents.select(F.concat(F.lit("wiki/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), content.alias("content"))
