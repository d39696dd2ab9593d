"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.run import compare, connect

FOLDER = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = connect(FOLDER)
    yield connection
    connection.close()


#: Queries that find nothing, rightly, in the small tables.
MAY_BE_EMPTY = {"bootstrap_attached", "leaked_prefixes", "leaked_rows", "config_overlap", "weak_metrics"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    problem = compare(spark, con, FOLDER, queries()[name], SQL[name])
    if name in MAY_BE_EMPTY and problem == "both sides are empty":
        problem = None
    assert problem is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 5
