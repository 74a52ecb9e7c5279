"""The operators' queries against SQL, on the smallest tables."""

import os

import duckdb
import pytest
from inkgraph.llm.queries import oracle_sql, queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries(), key=lambda x: int(x[2:].split("_")[0])))
def test_query(spark, name):
    rows = queries()[name](spark, FOLDER)
    got = rows.collect()
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "sale_lines", "vendors", "items"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    if name not in ("op11_leaderboard", "op12_chat"):  # a row for each document
        assert len(got) == con.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    if name in oracle_sql():
        want = con.sql(oracle_sql()[name])
        assert sorted(want.columns) == sorted(rows.columns)
        plain = lambda columns, row: repr([round(x, 5) if isinstance(x, float) else x for _, x in sorted(zip(columns, row, strict=True))])
        a, b = sorted(plain(rows.columns, r) for r in got), sorted(plain(want.columns, r) for r in want.fetchall())
        assert a == b, [x for x in zip(a, b, strict=True) if x[0] != x[1]][:2]
