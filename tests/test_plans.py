"""Work that plans must not do twice."""

from inkgraph.functions import markdown as md
from pyspark.sql import functions as F


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def pages(spark):
    return spark.createDataFrame([("a.md", "one [x](b.md) `[no](c.md)` [y](d.md#L1-L2)"), ("b.md", "plain [z](e.md)"), ("c.md", "none"), ("d.md", None)], "path string, content string")


def test_links_are_found_in_a_page_once(spark):
    made = pages(spark).withColumn("content", F.concat("content", F.lit("\n")))  # as if the text were derived
    assert optimized(md.links(made)).count("regexp_extract_all(clean") == optimized(md.links(made)).count("\\[([^\\[\\]]*)\\]\\(([^)]*)\\), 0)") == 1
    got = [(r.path, r.ordinal, r.href) for r in md.links(made).orderBy("path", "ordinal").collect()]
    assert got == [("a.md", 0, "b.md"), ("a.md", 1, "d.md#L1-L2"), ("b.md", 0, "e.md")]


def test_texts_without_marks_are_not_searched(spark):
    rows = pages(spark).select("path", F.length("content").alias("n"), F.length(md.scrub("content")).alias("m")).where("n is not null")
    assert all(r.n == r.m for r in rows.collect())
    assert "Contains(content" in optimized(pages(spark).select(md.scrub("content").alias("s")))
