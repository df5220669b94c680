"""Every registered query against its SQL in DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import connect, difference

SF = "/root/testdata/sf0.001"
#: Queries that find nothing in the smallest tables.
MAY_BE_EMPTY = {"ioc_semi_join"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    note = difference(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert note == "" or note == "NO ROWS" and name in MAY_BE_EMPTY, note


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "adjusted_score" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
