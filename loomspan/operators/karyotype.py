"""Collinear blocks, segments and breakpoints in gene order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.islands import run_merge


def packed_numbers(cell: Column, sep: str = "_") -> Column:
    """Numbers of a packed cell; empty and nan entries are left out."""
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), sep), lambda x: x.try_cast("double")), lambda x: x.isNotNull() & ~F.isnan(x))


def block_orientation(df: DataFrame, block: str, left: str, right: str) -> DataFrame:
    """'+' or '-' by the sign of the correlation of two order arrays; null where it isn't defined."""
    at = df.select(block, F.posexplode(F.arrays_zip(F.col(left).alias("l"), F.col(right).alias("r"))).alias("i", "z"))
    c = F.round(F.covar_pop(F.col("z.l").cast("double"), F.col("z.r").cast("double")), 9)  # has the correlation's sign
    return at.groupBy(block).agg(F.when(c > 0, "+").when(c < 0, "-").alias("orientation"))


def share_at_most(arr: Column, cut: float | Column) -> Column:
    """Share of an array's values that are at most ``cut``."""
    return F.try_divide(F.size(F.filter(arr, lambda x: x <= cut)), F.size(arr))


def ancestral_segments(genes: DataFrame, keys: list[str], order: str, colour: str) -> DataFrame:
    """Neighbouring genes of one colour as segments: first, last, genes."""
    return run_merge(genes, keys, [order], colour, [F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("genes")])


def breakpoint_flanks(blocks: DataFrame, windows: DataFrame, window: str, left_kind: str, right_kind: str) -> DataFrame:
    """For a coarse window (chrom, win_start, win_end, left_anc, right_anc): the last block of the left
    ancestry before its middle and the first block of the right ancestry after, and the class of width.

    Two as-of steps on the axis of a (chromosome, ancestry): running maximum of block ends, running
    minimum of block starts from behind. Windows without any block of either ancestry are left out.
    """
    mid = (F.col("win_start") + F.col("win_end")) / 2
    no = F.lit(None).cast(dict(windows.dtypes)[window])

    def as_of(edge: str, kind: str, name: str, up: bool) -> DataFrame:
        marks = blocks.where(F.col(edge).isNotNull()).select("chrom", F.col("ancestry").alias("__anc"), F.col(edge).cast("double").alias("__at"), F.lit(0).alias("__o"), F.col(edge).alias("__v"), no.alias("__w"))
        asks = windows.select("chrom", F.col(kind).alias("__anc"), mid.alias("__at"), F.lit(1).alias("__o"), F.lit(None).cast(blocks.schema[edge].dataType).alias("__v"), F.col(window).alias("__w"))
        w = Window.partitionBy("chrom", "__anc").orderBy(F.col("__at") if up else F.desc("__at"), "__o").rowsBetween(Window.unboundedPreceding, 0)
        # some block of the ancestry anywhere on the chromosome
        some = F.max("__v").over(Window.partitionBy("chrom", "__anc")).isNotNull()
        both = marks.unionByName(asks).withColumns({name: (F.max if up else F.min)("__v").over(w), f"__{name}": some})
        return both.where("__o = 1 and __w is not null").select(F.col("__w").alias(window), name, f"__{name}")

    g = as_of("end", left_kind, "left_end", True).join(as_of("start", right_kind, "right_start", False), window).where("__left_end or __right_start").drop("__left_end", "__right_start")
    width = F.col("right_start") - F.col("left_end")
    return g.withColumn("width_class", F.when(width.isNull(), "open").when(width <= 10_000, "narrow").when(width <= 100_000, "medium").otherwise("wide"))


def project_blocks(blocks: DataFrame, regions: DataFrame, flank: int) -> DataFrame:
    """Targets of each region (name, chrom, start, end) by the blocks over the flanked region, ranked by
    summed block length: name, target, bp, t_start, t_end, rank."""
    from loomspan.operators.intervals import Span, overlap_join

    wide = regions.select(F.col("name").alias("r_name"), F.col("chrom").alias("r_chrom"), F.greatest(F.col("start") - flank, F.lit(0)).alias("r_start"), (F.col("end") + flank).alias("r_end"))
    hit = overlap_join(wide, blocks, [("r_chrom", "q_name")], Span("r_start", "r_end"), Span("q_start", "q_end"))
    g = hit.groupBy("r_name", "t_name").agg(F.sum(F.col("q_end") - F.col("q_start")).alias("bp"), F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"))
    w = Window.partitionBy("r_name").orderBy(F.desc("bp"), "t_name")
    return g.withColumn("rank", F.row_number().over(w))
