"""Every query against its SQL, on the smallest tables."""

import os

import pytest
from conftest import DATA, against_sql

from loomspan.plans import QUERIES, SQL, flagship

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    got, want = against_sql(spark, QUERIES[name], SQL[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_flagship(spark):
    df = flagship(spark, DATA)
    assert df.count() > 0 and df.columns[0] == "user_id"


def test_entry_lists_all_queries(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_random_ones_repeat(spark):
    for name in ("hash_sample", "pan_core_sampled"):
        a, b = (sorted(map(repr, QUERIES[name](spark, DATA).collect())) for _ in range(2))
        assert a == b
