"""Queries of the llm problems against their SQL, and their whole results."""

import os

import pytest
from conftest import DATA, against_sql

from loomspan.llm.queries import QUERIES, SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    got, want = against_sql(spark, QUERIES[name], SQL[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.count() > 0
