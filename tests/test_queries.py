"""Every invoice query against its SQL in DuckDB; those without SQL must run."""

from __future__ import annotations

import pytest
from gristmill.plans import queries as invoices

from tests import compare

QUERIES, SQL = invoices.queries(), invoices.oracle_sql()


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    n, mine, theirs = compare.difference(QUERIES[name](spark, sf), compare.tables(sf), SQL[name])
    assert not mine and not theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
