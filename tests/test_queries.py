import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tallyframe import estimator_queries as estimator_queries
from tallyframe import history_queries as history_queries
from tallyframe import queries as queries
from tallyframe import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(df):
    names = sorted(df.columns)
    for n in names:
        if len(df) and (df[n].dtype.kind == "M" or hasattr(df[n].iloc[0], "isoformat")):
            df[n] = pd.to_datetime(df[n]).dt.strftime("%Y-%m-%d")
    return df[names].sort_values(names).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    got, want = plain(registry.QUERIES[name](spark, DATA).toPandas()), plain(con.execute(registry.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        if got[c].dtype.kind == "f":
            same |= (got[c] - want[c]).abs() <= 1e-6 * want[c].abs().clip(lower=1)
        assert same.all(), (c, got[~same].head(), want[~same].head())


def test_registry(spark):
    known, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(known) and set(registry.QUERIES) <= set(known)
    assert __spark_entry__.entry(spark).columns == ["brand", "period", "revenue"]
