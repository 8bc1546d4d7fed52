"""Periods and gaps against a set of covered positions."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomspan.operators.periods import merge_periods


def brute(rows):
    """rows: (key, a, b) -> {(key, kind, from, to)} by counting positions."""
    covered = {}
    for key, a, b in rows:
        if key is None or a is None or b is None:
            continue
        covered.setdefault(key, set()).update(range(min(a, b), max(a, b) + 1))
    out = set()
    for key, at in covered.items():
        at = sorted(at)
        start = prev = at[0]
        for p in at[1:]:
            if p > prev + 1:
                out |= {(key, "period", start, prev), (key, "gap", prev + 1, p - 1)}
                start = p
            prev = p
        out.add((key, "period", start, prev))
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "k string, a bigint, b bigint")
    got = [tuple(r) for r in merge_periods(df, ["k"], "a", "b", **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("shard", [4, 16, 1 << 20])
def test_random_intervals(spark, shard):
    rng = random.Random(shard)
    rows = []
    for key, n in (("hot", 300), ("x", 20), ("y", 1)):
        for _ in range(n):
            a = rng.randint(-50, 900)
            rows.append((key, a, a + rng.choice([-7, -1, 0, 1, 3, 9, 40])))
    rows += rows[:50]
    assert run(spark, rows, shard_units=shard) == brute(rows)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["p", "q", None]), st.one_of(st.none(), st.integers(-30, 60)), st.one_of(st.none(), st.integers(-30, 60))), max_size=25))
def test_any_intervals(spark, rows):
    assert run(spark, rows, shard_units=8) == brute(rows)


def test_touching_joins_and_one_apart_splits(spark):
    assert run(spark, [("k", 1, 5), ("k", 6, 9), ("k", 11, 12)]) == {("k", "period", 1, 9), ("k", "gap", 10, 10), ("k", "period", 11, 12)}


def test_runs_over_whole_shards(spark):
    rows = [("k", 0, 7), ("k", 8, 23), ("k", 40, 41)]
    assert run(spark, rows, shard_units=8) == brute(rows)


def test_empty_and_null_only(spark):
    assert run(spark, []) == set()
    assert run(spark, [(None, 1, 2), ("k", None, 2), ("k", 1, None)]) == set()


def test_clashing_column_names(spark):
    df = spark.createDataFrame([("k", 1, 5, 7, "z", 0)], "kind string, lo bigint, hi bigint, shard int, runs string, k0 int")
    assert [tuple(r) for r in merge_periods(df.withColumnRenamed("kind", "entity"), ["entity"], "lo", "hi").collect()] == [("k", "period", 1, 5)]


def test_several_keys_and_batches(spark, monkeypatch):
    import loomspan.operators.periods as m

    monkeypatch.setattr(m, "BUFFER_ROWS", 5)
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice(["+", "-"]), p := rng.randint(1, 300), p + rng.randint(0, 20)) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, s string, l bigint, r bigint").repartition(3)
    got = {(r["g"] + r["s"], r["kind"], r["from_pos"], r["to_pos"]) for r in merge_periods(df, ["g", "s"], "l", "r", shard_units=32).collect()}
    assert got == brute([(g + s, a, b) for g, s, a, b in rows])


def test_one_key_over_many_arrow_batches(spark):
    import random

    rng = random.Random(9)
    rows = [("hot", p := rng.randint(0, 500), p + rng.randint(0, 2)) for _ in range(600)] + [("a", 1, 2), ("z", 5, 6)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        df = spark.createDataFrame(rows, "k string, a bigint, b bigint").repartition(40)
        got = [tuple(r) for r in merge_periods(df, ["k"], "a", "b", shard_units=200).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert set(got) == brute(rows) and len(got) == len(set(got))


@pytest.mark.parametrize("kind", ["boolean", "date", "timestamp", "decimal(20,3)", "tinyint", "double", "binary", "string"])
def test_key_types(spark, kind):
    one, two = {"boolean": ("true", "false"), "date": ("2020-01-01", "2021-01-01"), "timestamp": ("2020-01-01", "2021-01-01")}.get(kind, ("1", "2"))
    rows = spark.sql(f"""
      select cast(case when k = 'a' then '{one}' else '{two}' end as {kind}) as k, k as name, a, b
      from values ('a', 1, 5), ('a', 6, 8), ('b', 2, 3), ('b', 9, 9), ('a', 20, 30) as t(k, a, b)""")
    names = {r["k"] if kind != "binary" else bytes(r["k"]): r["name"] for r in rows.collect()}
    got = {(names[r["k"] if kind != "binary" else bytes(r["k"])], r["kind"], r["from_pos"], r["to_pos"]) for r in merge_periods(rows, ["k"], "a", "b", shard_units=7).collect()}
    assert got == {("a", "period", 1, 8), ("a", "gap", 9, 19), ("a", "period", 20, 30), ("b", "period", 2, 3), ("b", "gap", 4, 8), ("b", "period", 9, 9)}
