"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest
from inkgraph.plans.queries import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def _plain(x):
    if isinstance(x, float):
        return int(x) if x.is_integer() else round(x, 5)
    return x


def ordered(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(None if x is None or x is pd.NA or x != x else _plain(x) for x in row)) for row in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert len(got.columns)
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        a, b = ordered(got), ordered(want)
        only = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        assert a == b, (len(a), len(b), only)
