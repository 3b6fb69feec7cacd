"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from check import check
from ledgerloom.plans import catalogue
from ledgerloom.plans.bindings import BASE

SF = "/root/testdata/sf0.001"
# The text chain, the model fits and the alignments are slow to compile; check.py covers them.
SLOW = ("extraction_queries", "category_queries", "quality_queries")
NAMES = [n for n, q in catalogue.queries().items() if not any(s in q.__module__ for s in SLOW)]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in BASE:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    message, good = check(spark, con, name, catalogue.queries()[name], catalogue.oracle_sql().get(name), SF)
    assert good, message


def test_every_query_is_callable_and_named_once():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
