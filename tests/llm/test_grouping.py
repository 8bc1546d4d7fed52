"""Groups against union-find."""

import random

import pytest

from pyspark.sql import functions as F

from loomspan.llm.grouping import hash_to_min, match_groups
from loomspan.operators.skew import heavy_values, spread_lookup
from loomspan.runtime import Stored


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def run(spark, pairs, kind="string"):
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs], f"a {kind}, b {kind}, hi string")
    rows = hash_to_min(df, "a", "b").collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: r["group_id"] for r in rows}


@pytest.mark.parametrize("shape", ["random", "chain", "star_high", "star_low", "clique", "tree"])
def test_shapes(spark, shape):
    rng = random.Random(len(shape))
    n = 120
    names = [f"v{i:04d}" for i in range(n)]
    rng.shuffle(names)
    pairs = {
        "random": [(rng.choice(names), rng.choice(names)) for _ in range(90)],
        "chain": list(zip(names, names[1:])),
        "star_high": [("zz", x) for x in names],
        "star_low": [("aa", x) for x in names],
        "clique": [(a, b) for a in names[:15] for b in names[:15]],
        "tree": [(names[i], names[(i - 1) // 2]) for i in range(1, n)],
    }[shape]
    assert run(spark, pairs) == brute(pairs)


def test_dirty_pairs(spark):
    pairs = [("a", "b"), ("b", "a"), ("a", "b"), ("c", "c"), (None, "a"), ("b", None), (None, None), ("", "é"), ("z", "Z")]
    assert run(spark, pairs) == {"a": "a", "b": "a", "": "", "é": "", "z": "Z", "Z": "Z"}


def test_numbers_and_empty(spark):
    assert run(spark, [(10, 9), (9, 100)], "bigint") == {9: 9, 10: 9, 100: 9}
    assert run(spark, []) == {}
    assert run(spark, [("a", "a")]) == {}


def test_unknown_ids_link_nothing(spark):
    m = spark.createDataFrame([("a", "x"), ("x", "b"), ("b", "c"), ("c", None)], "p string, q string")
    calls = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), (None,)], "id string")
    assert sorted(tuple(r) for r in match_groups(m, calls, "p", "q", "id").collect()) == [("b", "b"), ("c", "b")]


def test_rounds_are_bounded(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(64)], "a bigint, b bigint")
    with pytest.raises(RuntimeError):
        hash_to_min(df, "a", "b", max_rounds=1)
    assert {r["group_id"] for r in hash_to_min(df, "a", "b", max_rounds=12).collect()} == {0}


@pytest.mark.parametrize("hub", ["low", "high"])
def test_a_hub_is_no_hot_task(spark, hub):
    """A star of 20,000 edges: the largest reduce task of any join reads a small share of them."""
    n, parts = 20_000, 16
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        ends = (F.lit(-1), F.col("id")) if hub == "low" else (F.col("id"), F.lit(n))
        star = Stored(spark.range(n).select(ends[0].cast("bigint").alias("lo"), ends[1].cast("bigint").alias("hi"))).df
        heavy = heavy_values(star, "lo", "hi")
        key = "lo" if hub == "low" else "hi"
        assert heavy[key] == [-1 if hub == "low" else n]
        least = star.groupBy(F.col("hi").alias("v")).agg(F.min("lo").alias("m"))
        met = spread_lookup(star, key, least, "v", "m", "m", heavy[key], F.xxhash64("hi" if hub == "low" else "lo"))
        most = met.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.max("m")).agg(F.max("n"), F.max("max(m)")).first()[0]
        assert most < 2 * n / parts
        assert {r["group_id"] for r in hash_to_min(star, "lo", "hi").collect()} == {-1 if hub == "low" else 0}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
