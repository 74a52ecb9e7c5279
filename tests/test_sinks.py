import json
import random

import pytest
from inkgraph.sources import sinks
from pyspark.sql import functions as F


def read_array(folder):
    return json.loads("".join(f.read_text() for f in sorted(folder.iterdir()) if not f.name.startswith(".")))


def test_tree_is_whole_or_absent(spark, tmp_path):
    pages = spark.range(60).select(F.concat(F.lit("a/"), (F.col("id") % 7).cast("string"), F.lit("/p é "), F.col("id").cast("string"), F.lit(".md")).alias("path"), F.when(F.col("id") != 3, F.concat(F.lit("ä\n"), F.col("id").cast("string"))).alias("content"), F.lit(1).alias("value"))
    target = tmp_path / "tree"
    broken = pages.repartition(5).withColumn("content", F.when(F.col("path").endswith("41.md"), F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_tree(str(target), broken)
    assert list(tmp_path.iterdir()) == []
    sinks.write_tree("file:" + str(target), pages.repartition(5))
    want = {r.path: r.content or "" for r in pages.collect()}
    files = lambda: {str(p.relative_to(target)): p.read_text() for p in target.rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert files() == want
    with pytest.raises(Exception, match="tree"):
        sinks.write_tree(str(target), pages)
    with pytest.raises(ValueError, match="2 pages"):
        sinks.write_tree(str(target), pages.union(pages.limit(1)), overwrite=True)
    for path in ("", "/x", "a/../../x"):
        with pytest.raises(Exception, match="no path below"):
            sinks.write_tree(str(target), spark.createDataFrame([(path, "x")], "path string, content string"), overwrite=True)
    assert files() == want
    sinks.write_tree(str(target), pages.where("content like '%1'"), overwrite=True)
    assert files() == {k: v for k, v in want.items() if v.endswith("1")}
    assert [p.name for p in tmp_path.iterdir()] == ["tree"]


def test_array_is_ordered_over_parts(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([None, "x", "é", "\n", "a,b", '"']), rng.randrange(9)) for _ in range(400)]
    df = spark.createDataFrame(rows, "name string, value int").repartition(6)
    sinks.write_array(str(tmp_path / "a"), df.withColumnRenamed("value", "n"), ["n", "name"])
    key = lambda r: (r[1], r[0] is not None, (r[0] or "").encode())
    assert read_array(tmp_path / "a") == [({"name": a} if a is not None else {}) | {"n": n} for a, n in sorted(rows, key=key)]
    sinks.write_array(str(tmp_path / "a"), df.limit(0).withColumnRenamed("value", "n"), ["n"], overwrite=True)
    assert read_array(tmp_path / "a") == []
    with pytest.raises(Exception, match="lost"):
        sinks.write_array(str(tmp_path / "b"), df.select("name", F.when(F.col("value") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("value")).alias("n")), ["name"])
    assert [p.name for p in tmp_path.iterdir()] == ["a"]


def test_attempts_that_do_not_count_are_left_out(tmp_path):
    import pyarrow as pa

    writer = sinks.ArrayWriter(str(tmp_path / "a"), False)
    system = sinks._located(str(tmp_path))[0]
    part = lambda n, attempt, values: writer.write_part(system, n, attempt, iter([pa.RecordBatch.from_pydict({"value": pa.array(values, pa.string())})]))
    part(0, 1, ["1"])  # its executor was lost
    messages = [part(2, 5, ["4"]), part(0, 2, ["1", "2"]), part(1, 3, [])]
    writer.commit([*messages, None])
    assert read_array(tmp_path / "a") == [1, 2, 4]


def test_tree_is_read_back_whole_and_listed_by_tasks(spark, tmp_path):
    from inkgraph.sources import corpus as C

    folder = F.concat(F.element_at(F.array(*map(F.lit, ("_a", ".b", "._COPYING_", "c d%20#", "x/y/z"))), (F.col("id") % 5 + 1).cast("int")), F.lit("/"), (F.col("id") % 70).cast("string"))
    pages = spark.range(1400).select(F.concat(folder, F.lit("/"), F.element_at(F.array(*map(F.lit, ("_", ".", ""))), (F.col("id") % 3 + 1).cast("int")), "id", F.lit(".md.gz")).alias("path"), F.concat(F.lit("ä\r\n\0"), "id").alias("content"))
    want = {r.path: r.content for r in pages.collect()}
    assert len(want) == 1400  # more than a task lists by itself
    target = tmp_path / "tree"
    sinks.write_tree(str(target), pages.repartition(6))
    writer = sinks.TreeWriter(str(target), True)
    (target / f".draft-{writer.staging[-32:]}-7").write_text("half a pa")  # of a lost attempt
    (target / ".git").mkdir()
    (target / ".git/HEAD").write_text("ref")
    back = C.read_pages(spark, str(target))
    assert {r.path: r.content for r in back.collect()} == want and back.count() == 1400
    assert {r.path: (r.size_bytes, r.mtime_ns) for r in back.collect()} == {p: ((target / p).stat().st_size, (target / p).stat().st_mtime_ns) for p in want}
    assert not [f for f in back.inputFiles() if f.endswith(".gz")]  # the driver has no list of the pages
    (tmp_path / "none").mkdir()
    assert C.read_pages(spark, "file:" + str(tmp_path / "none")).collect() == []


def test_paths_of_one_file_are_not_written_over_each_other(spark, tmp_path):
    for paths in (["a//b.md", "a/b.md"], ["a/./b.md", "a/b.md"], ["./b.md"], ["a/"]):
        with pytest.raises(Exception, match="no path below"):
            sinks.write_tree(str(tmp_path / "tree"), spark.createDataFrame([(p, p) for p in paths], "path string, content string").coalesce(1))
    assert list(tmp_path.iterdir()) == []


def test_pages_of_a_store_that_spark_alone_reaches(spark, tmp_path):
    from inkgraph.sources import corpus as C

    (tmp_path / "d/e").mkdir(parents=True)
    (tmp_path / "d/e/a.md").write_text("é")
    spark.conf.set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    assert [(r.path, r.content, r.size_bytes) for r in C.read_pages(spark, "viewfs://store/in/d").collect()] == [("e/a.md", "é", 2)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        C.read_pages(spark, str(tmp_path / "gone"))
