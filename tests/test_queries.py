"""Every registered query with a check, side by side with DuckDB on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_agrees_with_sql(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], CHECKS[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)


def test_entry_has_rows(spark):
    rows = entry.entry(spark).collect()
    assert {r.tv for r in rows} == {0, 1} and len({r.records for r in rows}) == 1
