"""Lookups by skewed keys: right values, and no task with most of the rows."""

from pyspark.sql import functions as F

from loomspan.operators.skew import heavy_values, spread_key, spread_lookup


def test_heavy_values(spark):
    df = spark.createDataFrame([(7 if i % 3 == 0 else i, "x" if i % 2 else None) for i in range(3000)], "a bigint, b string")
    got = heavy_values(df, "a", "b", most=50)
    assert 7 in got["a"] and len(got["a"]) <= 50 and got["b"] == ["x"]
    assert heavy_values(df.limit(0), "a", "b") == {"a": [], "b": []}


def test_lookup_with_and_without_heavy_keys(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(500)] + [("cold", 1), ("none", 2), (None, 3), ("lost", 4)], "k string, n bigint")
    table = spark.createDataFrame([("hot", 1), ("cold", 2), ("other", 3)], "k string, v bigint")
    for heavy in ([], ["hot"], ["hot", "lost", "cold"]):
        got = spread_lookup(rows, "k", table, "k", "v", "v", heavy, F.xxhash64("n"))
        assert got.columns == ["k", "n", "v"]
        assert sorted((r.n, r.v) for r in got.where("k is null or k <> 'hot'").collect()) == [(1, 2), (2, None), (3, None), (4, None)]
        assert got.where("k = 'hot' and v = 1").count() == 500


def test_hot_key_is_spread(spark):
    star = spark.range(20_000).select((F.col("id") + 1).alias("hi"), F.lit(0).cast("bigint").alias("lo"))
    heavy = heavy_values(star, "lo")["lo"]
    assert heavy == [0]
    for key in ("lo", "__k"):
        spread = star.withColumn("__k", spread_key("lo", "bigint", heavy, F.xxhash64("hi")))
        most = spread.groupBy(F.expr(f"pmod(hash({key}), 16)")).count().agg(F.max("count")).first()[0]
        assert most == 20_000 if key == "lo" else most < 2_000
