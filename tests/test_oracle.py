"""Every registered query against its SQL on the same files."""

import pytest
from conftest import SMALL

import __spark_entry__ as entry
from tools.check_oracle import compare, connect

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, connection, name):
    assert compare(spark, connection, QUERIES[name], ORACLE[name], SMALL) == ""


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_returns_one_row(spark):
    assert entry.entry(spark).count() == 1
