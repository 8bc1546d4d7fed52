"""Gaps and islands, run-length merges, and other row-order analytics along an axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _axis(keys: list[str], order: list):
    return Window.partitionBy(*keys).orderBy(*order)


def island_ids(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 0, rule: str = "max", ties: list | None = None) -> DataFrame:
    """Adds ``island``, numbered from 1 within the keys.

    A row opens an island if its start is more than ``gap`` after the end of the row before (rule
    'last') or after the furthest end so far (rule 'max'). Half-open ends; for closed coordinates
    where adjacent intervals touch, pass gap = 1.
    """
    w = _axis(keys, [start, end, *(ties or [])])
    so_far = F.lag(end).over(w) if rule == "last" else F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__open", F.when(so_far.isNull() | (F.col(start) - so_far > gap), 1).otherwise(0))
    return df.withColumn("island", F.sum("__open").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__open")


#: Axis units of a shard. Long intervals cost a row per shard they touch.
SHARD = 1 << 22


def shard_cells(df: DataFrame, keys: list[str], start: str, end: str, width: int = SHARD, keep: list[str] = ()) -> DataFrame:
    """Half-open intervals cut at shard borders: keys, ``keep``, __shard, __lo, __hi and __first (1 on the
    first part of an interval). A hot key is thereby spread over its shards. Empty intervals get one part."""
    s, last = F.col(start).cast("bigint"), F.greatest(F.col(end).cast("bigint") - 1, F.col(start).cast("bigint"))
    w = F.lit(width).cast("bigint")
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*keys, *keep, s.alias("__s"), F.col(end).cast("bigint").alias("__e"), F.explode(F.sequence(F.floor(s / w), F.floor(last / w))).alias("__shard"))
    return rows.select(*keys, *keep, "__shard", F.greatest("__s", F.col("__shard") * w).alias("__lo"), F.least("__e", (F.col("__shard") + 1) * w).alias("__hi"), F.when(F.col("__s") >= F.col("__shard") * w, 1).otherwise(0).alias("__first"))


def merge_islands(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 0, rule: str = "max", aggs: list[Column] | None = None, ties: list | None = None) -> DataFrame:
    """One row per island: keys, start, end, n and further aggregates.

    With the rule 'max' and no further aggregates the axis is cut into shards: islands form within a
    (key, shard), and only those that touch a shard's border are stitched over the whole key, at most
    two a shard. Otherwise the rows of a key pass one sorted window.
    """
    if rule != "max" or aggs:
        rows = island_ids(df.where(F.col(start).isNotNull() & F.col(end).isNotNull()), keys, start, end, gap, rule, ties)
        return rows.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n"), *(aggs or [])).drop("island")
    # intervals that reach gap further right touch exactly where those at most gap apart should join
    cells = shard_cells(df.withColumn("__end", F.col(end) + gap), keys, start, "__end")
    w = _axis([*keys, "__shard"], ["__lo", "__hi"])
    top = F.max("__hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("__open", F.when(top.isNull() | (F.col("__lo") > top), 1).otherwise(0))
    cells = cells.withColumn("__run", F.sum("__open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = cells.groupBy(*keys, "__shard", "__run").agg(F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"), F.sum("__first").alias("n"))
    border = (F.col("__lo") % SHARD == 0) | (F.col("__hi") % SHARD == 0)
    over = _axis(keys, ["__lo"])
    edge = runs.where(border).withColumn("__open", F.when(F.lag("__hi").over(over).eqNullSafe(F.col("__lo")), 0).otherwise(1))
    edge = edge.withColumn("__run", F.sum("__open").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.groupBy(*keys, "__run").agg(F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"), F.sum("n").alias("n"))
    cols = [*keys, F.col("__lo").alias(start), (F.col("__hi") - gap).alias(end), "n"]
    return runs.where(~border).select(*cols).unionByName(edge.select(*cols))


def union_length(df: DataFrame, keys: list[str], start: str, end: str, closed: bool = False) -> DataFrame:
    """Positions covered by at least one interval of the keys, as ``bp``."""
    merged = merge_islands(df, keys, start, end, 1 if closed else 0)
    return merged.groupBy(*keys).agg(F.sum(F.col(end) - F.col(start) + (1 if closed else 0)).alias("bp"))


def list_gaps(df: DataFrame, keys: list[str], start: str, end: str, least: int = 1, closed: bool = False) -> DataFrame:
    """Uncovered stretches between merged intervals, at least ``least`` long: gap_start, gap_end.

    They come from the run bitmaps of the period operator, which needs no window over a whole key.
    """
    from loomspan.operators.periods import merge_periods

    one = 0 if closed else 1
    got = merge_periods(df.where(F.col(start) <= F.col(end) - one), keys, F.col(start), F.col(end) - one).where("kind = 'gap'")
    return got.where(F.col("to_pos") - F.col("from_pos") + 1 >= least).select(*keys, F.col("from_pos").alias("gap_start"), (F.col("to_pos") + one).alias("gap_end"))


def run_merge(df: DataFrame, keys: list[str], order: list, value: str, aggs: list[Column]) -> DataFrame:
    """Collapse neighbouring rows with an equal ``value`` (nulls equal): keys, run, value, aggregates."""
    w = _axis(keys, order)
    same = F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(F.lit(1)).over(w).isNotNull()
    runs = df.withColumn("__new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run", value).agg(*aggs)


def junctions(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """Neighbouring pairs: every row with the value of the next row as ``next_value``; the last row drops out."""
    w = _axis(keys, order)
    return df.withColumn("next_value", F.lead(value).over(w)).withColumn("__has", F.lead(F.lit(1)).over(w)).where("__has = 1").drop("__has")


def flanked_inserts(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """Rows whose neighbours on both sides agree with each other but not with them."""
    w = _axis(keys, order)
    return df.withColumns({"prev_value": F.lag(value).over(w), "next_value": F.lead(value).over(w)}).where((F.col("prev_value") == F.col("next_value")) & (F.col("prev_value") != F.col(value)))


def rolling_mean(value: Column | str, keys: list[str], order: list, radius: int = 2, zero_padded: bool = False) -> Column:
    """Centred moving average; truncated at the edges, or padded with zeros."""
    w = _axis(keys, order).rowsBetween(-radius, radius)
    return F.sum(value).over(w) / F.lit(float(2 * radius + 1)) if zero_padded else F.avg(value).over(w)


def local_maxima(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """Rows at least as high as both neighbours; the first and last row have but one."""
    w = _axis(keys, order)
    ge = lambda o: o.isNull() | (F.col(value) >= o)
    return df.withColumns({"__p": F.lag(value).over(w), "__n": F.lead(value).over(w)}).where(ge(F.col("__p")) & ge(F.col("__n"))).drop("__p", "__n")


def n50(df: DataFrame, keys: list[str], length: str, fraction: float = 0.5) -> DataFrame:
    """Length at which the lengths from the longest down reach the fraction of the total.

    Equal lengths are added up before the running sum, so a window holds distinct lengths only.
    """
    by = df.where(F.col(length).isNotNull()).groupBy(*keys, length).agg(F.sum(F.col(length)).alias("__s"))
    w = Window.partitionBy(*keys).orderBy(F.desc(length))
    whole = Window.partitionBy(*keys)
    run = by.withColumns({"__r": F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__t": F.sum("__s").over(whole)})
    return run.where(F.col("__r") >= F.col("__t") * fraction).groupBy(*keys).agg(F.max(length).alias("n50"))


def seed_extend(df: DataFrame, keys: list[str], order: list, score: str, start: str, end: str, floor: float = 0.25, share: float = 0.35) -> DataFrame:
    """The domain around each key's highest score: the run of rows with score >= max(floor, share * highest)."""
    whole = Window.partitionBy(*keys)
    w = _axis(keys, order)
    top = df.withColumn("__top", F.max(score).over(whole)).withColumn("__in", F.col(score) >= F.greatest(F.lit(floor), F.col("__top") * share))
    runs = top.withColumn("__new", F.when(F.col("__in").eqNullSafe(F.lag("__in").over(w)), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    dom = runs.where("__in").groupBy(*keys, "__run").agg(F.min(start).alias(start), F.max(end).alias(end), F.max(score).alias("peak"), F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("bins"))
    first = Window.partitionBy(*keys).orderBy(F.desc("peak"), start)
    return dom.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn", "__run")


def fill_gaps(df: DataFrame, keys: list[str], start: str, end: str, value: str, length: str) -> DataFrame:
    """Extend segments over the gaps between them, meeting at the middle, and to 0 and ``length`` at the
    ends; then merge neighbours with an equal value."""
    w = _axis(keys, [start, end])
    pe, ns = F.lag(end).over(w), F.lead(start).over(w)
    grown = df.withColumns({"__s": F.when(pe.isNull(), F.lit(0)).otherwise(pe + F.floor((F.col(start) - pe) / 2)), "__e": F.when(ns.isNull(), F.col(length)).otherwise(F.col(end) + F.floor((ns - F.col(end)) / 2))})
    out = run_merge(grown, keys, [start, end], value, [F.min("__s").alias(start), F.max("__e").alias(end)])
    return out.drop("run")


def longest_run(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The longest merged interval of the keys."""
    merged = merge_islands(df, keys, start, end)
    w = Window.partitionBy(*keys).orderBy(F.desc(F.col(end) - F.col(start)), start)
    return merged.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
