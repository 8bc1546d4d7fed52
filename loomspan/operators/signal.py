"""Signals along an axis: weighted means, fixed windows, enrichment, interval composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.intervals import Span, overlap_join
from loomspan.operators.islands import merge_islands


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: sum(v * w) / sum(w) over rows where both are known; null without weight."""
    known = value.isNotNull() & weight.isNotNull()
    return F.try_divide(F.sum(F.when(known, value * weight)), F.sum(F.when(known, weight)))


def window_start(pos: Column, width: int) -> Column:
    return (F.floor(pos / width) * width).cast("bigint")


def ratio_windows(df: DataFrame, keys: list[str], pos: str, hit: Column, total: Column, width: int) -> DataFrame:
    """Sum of hits / sum of totals in fixed windows; windows without a total are left out."""
    g = df.groupBy(*keys, window_start(F.col(pos), width).alias("win_start")).agg(F.sum(hit).alias("hits"), F.sum(total).alias("total"))
    return g.where("total > 0").withColumn("ratio", F.col("hits") / F.col("total"))


def complete_windows(df: DataFrame, sizes: DataFrame, keys: list[str], size: str, width: int, fill: dict) -> DataFrame:
    """All windows of every axis of ``sizes``, with ``fill`` where ``df`` has none."""
    axis = sizes.where(F.col(size) > 0).select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col(size) - 1).cast("bigint"), F.lit(width).cast("bigint"))).alias("win_start"))
    return axis.join(df, [*keys, "win_start"], "left").na.fill(fill)


def feature_density(df: DataFrame, keys: list[str], start: str, end: str, width: int) -> DataFrame:
    """Per window: features that start in it (and per Mb), and the fraction covered by any feature."""
    starts = df.groupBy(*keys, window_start(F.col(start), width).alias("win_start")).agg(F.count(F.lit(1)).alias("features"))
    merged = merge_islands(df, keys, start, end)
    part = merged.withColumn("win_start", F.explode(F.sequence(window_start(F.col(start), width), window_start(F.col(end) - 1, width), F.lit(width).cast("bigint"))))
    cover = part.groupBy(*keys, "win_start").agg(F.sum(F.least(F.col(end), F.col("win_start") + width) - F.greatest(F.col(start), F.col("win_start"))).alias("covered"))
    both = cover.join(starts, [*keys, "win_start"], "left").na.fill(0, ["features"])
    return both.withColumns({"per_mb": F.col("features") * 1e6 / width, "fraction": F.col("covered") / width})


def region_stats(signal: DataFrame, regions: DataFrame, keys: list[tuple[str, str]], sspan: Span, rspan: Span, region: str, value: str) -> DataFrame:
    """Per region: covered bp, length-weighted mean, least and greatest value, and the fractions of the
    region that are covered, positive and negative. Signal intervals should not overlap each other."""
    pairs = overlap_join(signal, regions, keys, sspan, rspan).where("overlap > 0")
    s, e = rspan.bounds()
    return pairs.withColumn("__w", e - s).groupBy(region).agg(
        F.sum("overlap").alias("covered_bp"),
        weighted_mean(F.col(value), F.col("overlap")).alias("mean"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        (F.sum("overlap") / F.first("__w")).alias("covered_fraction"),
        (F.sum(F.when(F.col(value) > 0, F.col("overlap")).otherwise(0)) / F.first("__w")).alias("positive_fraction"),
        (F.sum(F.when(F.col(value) < 0, F.col("overlap")).otherwise(0)) / F.first("__w")).alias("negative_fraction"),
    )


def enrichment(counts: DataFrame, keys: list[str], chip: str, control: str, pseudo: float = 0.25) -> DataFrame:
    """log2((rpm chip + pseudo) / (rpm control + pseudo)) with the totals of both columns as library sizes."""
    totals = counts.agg(F.sum(chip).alias("__tc"), F.sum(control).alias("__ti"))
    rpm = lambda c, t: F.coalesce(F.try_divide(F.col(c) * 1e6, F.col(t)), F.lit(0.0))
    out = counts.join(F.broadcast(totals))
    out = out.withColumns({"chip_rpm": rpm(chip, "__tc"), "control_rpm": rpm(control, "__ti")})
    return out.withColumn("log2_enrichment", F.log2((F.col("chip_rpm") + pseudo) / (F.col("control_rpm") + pseudo))).drop("__tc", "__ti")


def zip_windows(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one join of two window tables; fails at run time if a window has no partner."""
    both = a.withColumn("__a", F.lit(1)).join(b.withColumn("__b", F.lit(1)), keys, "full_outer")
    ok = F.assert_true(F.col("__a").isNotNull() & F.col("__b").isNotNull(), F.lit("windows of the two tables differ"))
    return both.withColumn("__ok", ok).where(F.col("__ok").isNull()).drop("__a", "__b", "__ok")


def _cover(regions: DataFrame, key: str, span: Span) -> DataFrame:
    """Disjoint stretches (__k, __rs, __re) that the regions cover."""
    s, e = span.bounds()
    return merge_islands(regions.select(F.col(key).alias("__k"), s.alias("__rs"), e.alias("__re")).where("__rs < __re"), ["__k"], "__rs", "__re").drop("n")


def share_in_regions(points: DataFrame, regions: DataFrame, key: tuple[str, str], pos: str, rspan: Span, row_id: str) -> DataFrame:
    """One row: points, those inside any region, and their share."""
    p = points.select(row_id, key[0], F.col(pos).alias("__p"), (F.col(pos) + 1).alias("__p1"))
    inside = overlap_join(p, _cover(regions, key[1], rspan), [(key[0], "__k")], Span("__p", "__p1"), Span("__rs", "__re")).select(row_id).distinct().withColumn("__in", F.lit(1))
    return p.join(inside, row_id, "left").agg(F.count(F.lit(1)).alias("points"), F.count("__in").alias("inside"), (F.count("__in") / F.count(F.lit(1))).alias("share"))


def overlap_fractions(regions: DataFrame, features: DataFrame, key: tuple[str, str], rspan: Span, fspan: Span, region: str, cls: str) -> DataFrame:
    """Per region (one row each) and class the fraction covered by the union of the class's features.

    The features of a class are merged before they meet the regions. Then they are disjoint, so that
    overlaps add up before the shuffle, and no pair is sorted.
    """
    fs, fe = fspan.bounds()
    rs, re_ = rspan.bounds()
    union = merge_islands(features.select(key[1], cls, fs.alias("__fs"), fe.alias("__fe")).where("__fs < __fe"), [key[1], cls], "__fs", "__fe")
    pairs = overlap_join(regions, union, [key], rspan, Span("__fs", "__fe")).where("overlap > 0")
    return pairs.groupBy(region, cls).agg((F.sum("overlap") / F.first(re_ - rs)).alias("fraction"))


def consensus_interval(raw: tuple[Column, Column], relaxed: tuple[Column, Column], strict: tuple[Column, Column], share: float = 0.5, strict_share: float = 0.25) -> Column:
    """struct(start, end, used, status, overlap, note) from three calls of one domain, any of them null.

    The core is the union of raw and relaxed, of the one that exists, or the strict call. The strict
    call joins it if their overlap is ``strict_share`` of either. Null if there is no call.
    """

    def known(x: tuple[Column, Column]) -> Column:
        return x[0].isNotNull() & x[1].isNotNull()

    def overlap(x: tuple[Column, Column], y: tuple[Column, Column]) -> Column:
        return F.greatest(F.least(x[1], y[1]) - F.greatest(x[0], y[0]), F.lit(0))

    def at_least(bp: Column, part: float, whole: Column) -> Column:
        return bp / F.greatest(whole, F.lit(1)) >= part

    a, b, q = known(raw), known(relaxed), known(strict)
    near = at_least(overlap(raw, relaxed), share, F.least(raw[1] - raw[0], relaxed[1] - relaxed[0]))
    core = tuple(F.when(a & b, f(raw[i], relaxed[i])).when(a, raw[i]).when(b, relaxed[i]).when(q, strict[i]) for i, f in ((0, F.least), (1, F.greatest)))
    shared = F.when(q, overlap(core, strict)).otherwise(F.lit(0)).cast("bigint")
    joins = q & (at_least(shared, strict_share, strict[1] - strict[0]) | at_least(shared, strict_share, core[1] - core[0]))
    end = tuple(F.when(joins, f(core[i], strict[i])).otherwise(core[i]) for i, f in ((0, F.least), (1, F.greatest)))
    used = F.concat_ws(",", F.when(a, "raw"), F.when(b, "relaxed"), F.when(joins, "q20"))
    status = F.when(~q, "missing").when(joins, "concordant_or_partly_overlapping").otherwise("discordant_excluded")
    first = F.when(a & b & near, "raw_relaxed_concordant").when(a & b, "raw_relaxed_broad_or_split").when(a, "raw_only").when(b, "relaxed_only").otherwise("q20_only")
    note = F.concat_ws(";", first, F.when(joins, "q20_included").when(q, "q20_discordant_excluded"))
    out = F.struct(end[0].alias("start"), end[1].alias("end"), used.alias("used"), status.alias("status"), shared.alias("overlap"), note.alias("note"))
    return F.when(a | b | q, out)


def flank_depth_gate(depth: DataFrame, record: str, value: str, least_min: float, least_mean: float) -> DataFrame:
    """Pass or fail of each record from the depths of its flank windows, with the reason."""
    g = depth.groupBy(record).agg(F.min(value).alias("min_depth"), F.avg(value).alias("mean_depth"), F.count(value).alias("windows"))
    reason = F.when(F.col("windows") == 0, "no_depth").when(F.col("min_depth") < least_min, "low_min").when(F.col("mean_depth") < least_mean, "low_mean").otherwise("pass")
    return g.withColumn("reason", reason)


def per_class_bins(df: DataFrame, keys: list[str], lo: float, hi: float, bins: int, value: str, outside: bool = False) -> DataFrame:
    """Histogram with equal bins on [lo, hi]; the last bin is closed. Values outside are left out or,
    with ``outside``, counted in further bins of the same width, numbered on."""
    width = (hi - lo) / bins
    idx = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("int")
    kept = (F.col(value) >= lo) & (F.col(value) <= hi)
    if outside:
        kept, idx = F.abs(F.col(value)) < float("inf"), F.when(F.col(value) == hi, bins - 1).otherwise(F.floor((F.col(value) - lo) / width)).cast("int")
    return df.where(kept).groupBy(*keys, idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def dominant_source(df: DataFrame, keys: list[str], source: str, bp: str) -> DataFrame:
    """Per bin the source with the most overlap, and all sources listed as 'source:bp'."""
    g = df.groupBy(*keys, source).agg(F.sum(bp).alias("bp"))
    w = Window.partitionBy(*keys).orderBy(F.desc("bp"), source)
    ranked = g.withColumn("rn", F.row_number().over(w))
    return ranked.groupBy(*keys).agg(F.max(F.when(F.col("rn") == 1, F.col(source))).alias("top"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.concat_ws(":", source, F.col("bp").cast("string")).alias("x")))), lambda v: v["x"]), ";").alias("listing"))
