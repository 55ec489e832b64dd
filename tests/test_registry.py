"""Registered queries on the smallest data set, next to their SQL in DuckDB."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as contract  # noqa: E402
from tools.check_queries import compare, connect  # noqa: E402

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "company" and df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, connection, sf_dir, name):
    ok, message, _ = compare(spark, connection, QUERIES[name], ORACLES[name], sf_dir)
    assert ok, message
