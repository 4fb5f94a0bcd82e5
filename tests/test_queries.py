"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from checks import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
RUN, SQL = queries(), oracle_sql()
# nothing to compare at this size: no row of the small tables qualifies
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(RUN))
def test_query(spark, con, name):
    df = RUN[name](spark, SF)
    if name not in SQL:
        assert df.count() > 0
        return
    out = compare(df, con, SQL[name])
    assert out is None or (out == "EMPTY" and name in MAY_BE_EMPTY), out


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["source", "chunks", "docs", "chars", "longest"]
    assert df.count() > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(RUN)
