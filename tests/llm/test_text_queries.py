"""The text queries against their SQL, on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from check_queries import TABLES, differences  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_all_operators_are_registered():
    found = {name.split("_")[0] for name in entry.TEXT_QUERIES}
    assert found == {"pipeline", *(f"op{n}" for n in range(1, 11))}


@pytest.mark.parametrize("name", sorted(entry.TEXT_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    assert differences(got, con.sql(entry.oracle_sql()[name]).df()) is None
