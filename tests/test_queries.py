"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest
from check_queries import TABLES, differences

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(entry.QUERIES) == set(entry.SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(entry.QUERIES))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert differences(got, con.sql(entry.oracle_sql()[name]).df()) is None
