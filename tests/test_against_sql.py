"""Every registered query against its SQL: names, types and values."""

import pytest

import __spark_entry__ as entry

from . import compare

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.database(sf_dir)


def test_every_query_has_sql():
    assert set(SQL) <= set(QUERIES)
    without = set(QUERIES) - set(SQL)
    assert all(name == "pipeline" or name.startswith("op") for name in without)  # tested in tests/llm


@pytest.mark.parametrize("name", SQL)
def test_query(name, spark, sf_dir, con):
    types, rows = compare.actual(QUERIES[name](spark, sf_dir))
    expected_types, expected_rows = compare.expected(con, SQL[name])
    assert types == expected_types
    assert rows == expected_rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
