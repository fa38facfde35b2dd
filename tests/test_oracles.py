"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    detail, ok = compare(spark, con, FOLDER, name, QUERIES[name], SQL.get(name))
    assert ok, detail


def test_every_sql_has_a_query():
    assert not set(SQL) - set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
