"""Counting, ranking, set and sort helpers with an explicit total order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_default(left: DataFrame, right: DataFrame, on: list[str], defaults: dict) -> DataFrame:
    """Left join; missing values of the right's columns become their defaults."""
    return left.join(right, on, "left").na.fill(defaults)


def outer_all(frames: list[DataFrame], on: list[str], fill: float | None = 0) -> DataFrame:
    """Full outer join of several tables on the same keys, nulls filled."""
    out = reduce(lambda a, b: a.join(b, on, "full_outer"), frames)
    return out if fill is None else out.na.fill(fill)


def fixed_categories(df: DataFrame, col: str, names: list[str]) -> DataFrame:
    """Count and percentage per listed category, zeros included, in the listed order (``ord``)."""
    axis = df.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], f"{col} string, ord int")
    have = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    out = axis.join(have, col, "left").na.fill(0, ["n"])
    return out.withColumn("pct", F.coalesce(F.try_divide(F.col("n") * 100.0, F.sum("n").over(Window.partitionBy(F.lit(0)))), F.lit(0.0)))


def distinct_string(col: Column | str, sep: str = ";") -> Column:
    """Aggregate: the sorted distinct values joined to one string."""
    return F.array_join(F.array_sort(F.collect_set(col)), sep)


def top_k_string(df: DataFrame, keys: list[str], item: str, k: int = 5) -> DataFrame:
    """The ``k`` most frequent items per keys as 'item:n;...', ties by item."""
    n = df.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), item)
    top = n.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return top.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.concat_ws(":", item, F.col("n").cast("string")).alias("s")))), lambda x: x["s"]), ";").alias("top"))


def top_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows per keys with ``rank`` and ``role`` (primary, secondary)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return out.withColumn("role", F.when(F.col("rank") == 1, "primary").otherwise("secondary"))


def top_or_other(df: DataFrame, col: str, n: int, other: str = "other") -> DataFrame:
    """Adds ``display``: the value if it is one of the n most frequent (ties by value), else ``other``."""
    top = df.groupBy(col).agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), col).limit(n).select(F.col(col).alias("__t"))
    return df.join(top, F.col(col) == F.col("__t"), "left").withColumn("display", F.when(F.col("__t").isNotNull(), F.col(col)).otherwise(other)).drop("__t")


def padded(number: Column, width: int) -> Column:
    """A number with zeros in front up to ``width``; longer ones stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def surrogate_ids(df: DataFrame, order: list, prefix: str, width: int = 8) -> DataFrame:
    """Adds ``sid``: prefix and zero-padded running number in a total order; a number of more
    than ``width`` digits is not cut.

    Two steps, so that no task sees all rows: rows are range-partitioned by the order and numbered
    within their partition; the counts of the partitions before give the offset.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    from loomspan.runtime import Stored

    kept = Stored(parts.withColumn("__i", F.monotonically_increasing_id() % F.lit(1 << 33)), "ids").df
    counts = kept.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("__o", F.coalesce(F.sum("__c").over(w), F.lit(0))).drop("__c")
    out = kept.join(F.broadcast(offs), "__p")
    return out.withColumn("sid", F.concat(F.lit(prefix), padded(F.col("__o") + F.col("__i") + 1, width))).drop("__p", "__i", "__o")


def natural_key(name: Column) -> list[Column]:
    """Sort keys that order 'chr2' before 'chr10'."""
    return [F.regexp_replace(name, r"\d+$", ""), F.regexp_extract(name, r"(\d+)$", 1).try_cast("bigint"), name]


def preferred_rank(col: Column, order: list[str], last: int = 999) -> Column:
    """Position in a fixed list, from 1; values not listed come last."""
    rank = F.lit(last)
    for i, v in reversed(list(enumerate(order))):
        rank = F.when(col == v, i + 1).otherwise(rank)
    return rank


def ranked_contigs(df: DataFrame, contig: str, order: DataFrame, order_contig: str, rank: str) -> DataFrame:
    """Adds ``contig_rank`` from a dimension table; unknown contigs come after all others."""
    return df.join(order.select(F.col(order_contig).alias("__c"), F.col(rank).alias("contig_rank")), F.col(contig) == F.col("__c"), "left").drop("__c").na.fill({"contig_rank": 2**31 - 1})


def sample_rows(df: DataFrame, n: int, seed: int, key: list[str]) -> DataFrame:
    """``n`` rows chosen by a digest of the seed and their key: the same rows in any partitioning."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)).cast("binary")), *key).limit(n)


def same_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``equal``: whether two one-column tables hold the same distinct values."""
    x, y = a.toDF("v").distinct(), b.toDF("v").distinct()
    diff = x.join(y, x["v"].eqNullSafe(y["v"]), "left_anti").unionByName(y.join(x, y["v"].eqNullSafe(x["v"]), "left_anti"))
    return diff.agg((F.count(F.lit(1)) == 0).alias("equal"))


def must_know(df: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Fails at run time on a key that the known table lacks."""
    mark = known.select(F.col(known_key).alias("__k")).distinct()
    out = df.join(mark, F.col(key) == F.col("__k"), "left")
    return out.withColumn("__ok", F.assert_true(F.col("__k").isNotNull(), F.concat(F.lit("unknown key "), F.col(key).cast("string")))).where("__ok is null").drop("__ok", "__k")


def unique_or_fail(df: DataFrame, keys: list[str]) -> DataFrame:
    """Fails at run time on repeated keys."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    bad = n.where("__n > 1").agg(F.count(F.lit(1)).alias("__bad"))
    out = df.join(F.broadcast(bad))
    return out.withColumn("__ok", F.assert_true(F.col("__bad") == 0, F.lit("repeated keys"))).where("__ok is null").drop("__ok", "__bad")


def two_scopes(df: DataFrame, inside: Column, keys: list[str], aggs: list[Column]) -> DataFrame:
    """The same aggregates over all rows ('all') and over those inside a region ('region')."""
    scoped = df.withColumn("scope", F.explode(F.when(inside, F.array(F.lit("all"), F.lit("region"))).otherwise(F.array(F.lit("all")))))
    return scoped.groupBy("scope", *keys).agg(*aggs)


def unordered_pairs(df: DataFrame, key: list[str], item: str, cond=None) -> DataFrame:
    """Pairs a < b of rows that share a key, filtered by ``cond(left, right)``; for small stated groups."""
    l, r = df.alias("l"), df.alias("r")
    on = reduce(lambda x, y: x & y, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in key]) & (F.col(f"l.{item}") < F.col(f"r.{item}"))
    if cond is not None:
        on = on & cond(lambda c: F.col(f"l.{c}"), lambda c: F.col(f"r.{c}"))
    return l.join(r, on)


def chunks(df: DataFrame, keys: list[str], order: list, size: int, start: str, end: str, pad: int) -> DataFrame:
    """Chunks of at most ``size`` rows per keys, with padded, clipped spans: chunk, n, start, end."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size))
    return rows.groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.min(start) - pad, F.lit(0)).alias("chunk_start"), (F.max(end) + pad).alias("chunk_end"))


def wide_matrix(df: DataFrame, row: str, col: str, value: str, cols: list[str], fill: float = 0.0) -> DataFrame:
    """Pivot with a fixed list of columns, missing cells filled."""
    return df.groupBy(row).pivot(col, cols).agg(F.first(value)).na.fill(fill)


def dense_grid(pairs: DataFrame, a: str, b: str, value: str, names: list[str]) -> DataFrame:
    """Every ordered pair of listed names with the value of the unordered pair, null where unknown."""
    spark = pairs.sparkSession
    axis = spark.createDataFrame([(x, y, i, j) for i, x in enumerate(names) for j, y in enumerate(names)], f"{a} string, {b} string, i int, j int")
    known = pairs.select(F.least(a, b).alias("__a"), F.greatest(a, b).alias("__b"), F.col(value))
    return axis.join(known, (F.least(a, b) == F.col("__a")) & (F.greatest(a, b) == F.col("__b")), "left").select(a, b, value)
