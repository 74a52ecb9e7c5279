"""The corpus pipeline: five stages, each one operator over all rows that its predecessor kept.

Each stage's rows are written as Parquet and read again as the next one's ``docs``.  Every stage takes
nulls in any column, rows that repeat an id or have none, empty tables and further columns of any
name, and returns the columns that it got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkgraph.llm import bpe, decontaminate, jaccard, lines, quality
from inkgraph.llm.queries import word_tokenizer
from inkgraph.llm.storage import scratch, written

#: Ids that are sent to all executors at most; more are joined by shuffling.
BROADCAST_IDS = 1_000_000


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have, in any case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _sent(ids: DataFrame) -> DataFrame:
    """Written ids, broadcast if they are few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _judged(docs: DataFrame, operator, bad) -> DataFrame:
    """``docs`` without the rows an operator rejects by text and language; it sees the rows' numbers as ids, so no other row goes."""
    row = _fresh(docs, "row_number")
    with scratch() as kept:
        rows = _numbered(docs, row, kept)
        gone = kept(written(operator(rows.select(F.col(row).alias("doc_id"), "text", "lang")).where(bad).select(F.col("doc_id").alias(row)), "rejected"))
        return rows.join(_sent(gone), row, "left_anti").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, and no others that share their id."""
    return _judged(docs, quality.judge, ~F.col("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents of which no word is left by that; ``n_chars`` follows the text."""
    aside = {c: _fresh(docs, c) for c in docs.columns if c.lower() in ("n_lines", "n_removed")}  # the operator adds columns of these names
    out = lines.dedup_lines(docs.withColumnsRenamed(aside), exact=1, chars=True)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = out.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop("n_lines", "n_removed").withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)


def _entered(spark: SparkSession, rows: DataFrame, row: str, sf_dir: str) -> DataFrame:
    """(row, text) of the rows whose text was another one in ``documents``; ids that stand there more than once name no text."""
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id is not null")
    marks = whole.select("doc_id", F.xxhash64("text").alias("was")).groupBy("doc_id").agg(F.count("*").alias("n"), F.first("was").alias("was")).where("n = 1")
    changed = rows.select("doc_id", row, F.xxhash64("text").alias("now")).join(marks, "doc_id").where("was <> now").select("doc_id", row)
    return whole.join(_sent(written(changed, "changed")), "doc_id").select(row, "text")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest id (null last).

    Rows are told apart by number, so rows that share an id or have none are deduplicated like others.
    A text that line dedup cut also counts as it was: two documents belong together if they are
    near copies by either text, so no scrap of a near copy stays.  Rows without a word stay.
    """
    with scratch() as kept:
        row = _fresh(docs, "row_number")
        rows = _numbered(docs, row, kept)
        return rows.join(_sent(kept(_copies(spark, rows, row, sf_dir))), row, "left_anti").select(*docs.columns)


def _numbered(docs: DataFrame, row: str, kept) -> DataFrame:
    """``docs`` with a number for each row, by its file and its place there: the same one however often and wherever it is read."""
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":  # no files as they are: write them
        docs = kept(written(docs, "rows"))
    place, file, at = docs.metadataColumn("_metadata"), _fresh(docs, "file"), _fresh(docs, "at")
    files = docs.select(place["file_path"].alias(file)).distinct()
    files = kept(written(files.withColumn("number", F.row_number().over(Window.orderBy(file))), "files"))  # a row for each file
    rows = docs.select("*", place["file_path"].alias(file), place["row_index"].alias(at)).join(F.broadcast(files.withColumnRenamed("number", row)), file)
    return rows.withColumn(row, F.shiftleft(F.col(row).cast("long"), 40) + F.col(at)).select(*docs.columns, row)


def _copies(spark: SparkSession, rows: DataFrame, row: str, sf_dir: str) -> DataFrame:
    """The numbers of the rows that go, as a written table."""
    both = rows.select((F.col(row) * 2).alias("doc_id"), "text").union(_entered(spark, rows, row, sf_dir).select((F.col(row) * 2 + 1).alias("doc_id"), "text"))
    # both texts of a row belong together, so they are not compared with each other
    found = jaccard.join_components(both, tied=F.shiftright("doc_id", 1)).where("n_shingles > 0")
    named = found.select(F.shiftright("doc_id", 1).alias(row), F.col("component_id").alias("component")).distinct()
    # the first of each group by id is found on narrow rows, and only the rows of the others are sent to the texts
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)
    narrow = written(rows.select("doc_id", row).join(named, row), "narrow")
    first = narrow.groupBy("component").agg(F.min(place).alias("first"))
    return written(narrow.join(first, "component").where(F.col("first")[row] != F.col(row)).select(row), "copies")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, and no others that share their id."""
    return _judged(docs, lambda d: decontaminate.decontaminate(d, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), F.col("contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return bpe.encode_documents(docs, word_tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", encode),
]

#: The stages are not expressible in SQL as a whole; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
