"""Every registered query against its SQL on the smallest test data."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_sql(spark, con, key):
    same, why, _ = compare(spark, con, FOLDER, QUERIES[key], ORACLES[key])
    assert same, why


def test_every_own_query_has_sql():
    own = {*entry.statement_plans.QUERIES, *entry.workload_plans.QUERIES}
    assert own <= set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0]["total_queries"] >= rows[-1]["total_queries"]
