"""Presence/absence algebra: long tables of (item, sample, state) with state 1, 0 or null."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def presence_numeric(v: Column) -> Column:
    """Present if a number above 0, or a text that is no missing mark and no absent genotype."""
    num = v.try_cast("double")
    missing = v.isNull() | F.trim(v).isin("", ".", "NA", "NaN", "nan")
    return F.when(missing, F.lit(False)).when(num.isNotNull(), num > 0).otherwise(~F.trim(v).isin("0", "./.", "0/0"))


def presence_token(v: Column) -> Column:
    return ~F.coalesce(v, F.lit("")).isin("0", ".", "", "NA")


def presence_truthy(v: Column) -> Column:
    return F.coalesce(F.lower(F.trim(v)).isin("1", "1.0", "true", "yes", "y", "t", "present"), F.lit(False))


def genotype_state(gt: Column) -> Column:
    """1 with any non-reference allele, 0 with reference alleles only, null with none called."""
    alleles = F.filter(F.split(F.regexp_replace(F.split(gt, ":")[0], r"\|", "/"), "/"), lambda x: (x != ".") & (x != ""))
    return F.when(gt.isNull() | (F.size(alleles) == 0), F.lit(None)).when(F.exists(alleles, lambda x: x != "0"), 1).otherwise(0)


def genotype_strict(gt: Column) -> Column:
    """True only for biallelic calls with allele 1."""
    return F.coalesce(F.regexp_replace(F.split(gt, ":")[0], r"\|", "/").isin("0/1", "1/0", "1/1"), F.lit(False))


def support_states(vec: Column, n: int) -> Column:
    """Array of 0/1 from a support vector; null unless its length is n."""
    return F.when(F.length(vec) == n, F.transform(F.split(vec, ""), lambda c: c.cast("int")))


def combine_states(*states: Column) -> Column:
    """1 if any is 1, else 0 if any is 0, else null."""
    return F.greatest(*states)


def sample_columns(df: DataFrame, metadata: list[str], exclude: list[str] = (), prefix: str | None = None) -> list[str]:
    return [c for c in df.columns if c not in metadata and c not in exclude and (prefix is None or c.startswith(prefix))]


def to_long(df: DataFrame, ids: list[str], samples: list[str]) -> DataFrame:
    return df.unpivot(ids, samples, "sample", "state")


def sample_stats(long: DataFrame, item: str, sample: str, state: str) -> DataFrame:
    """Per sample: present, absent, missing, missing_rate and singleton (items present only there)."""
    one = long.withColumn("__n", F.sum(F.when(F.col(state) == 1, 1).otherwise(0)).over(Window.partitionBy(item)))
    return one.groupBy(sample).agg(
        F.count_if(F.col(state) == 1).alias("present"),
        F.count_if(F.col(state) == 0).alias("absent"),
        F.count_if(F.col(state).isNull()).alias("missing"),
        (F.count_if(F.col(state).isNull()) / F.count(F.lit(1))).alias("missing_rate"),
        F.count_if((F.col(state) == 1) & (F.col("__n") == 1)).alias("singleton"),
    )


def frequencies(present: DataFrame, item: str, sample: str) -> DataFrame:
    """(item, n_samples) of present (item, sample) rows, repeated rows counting once."""
    return present.groupBy(item).agg(F.count_distinct(sample).alias("n_samples"))


def shared_specific(present: DataFrame, item: str, sample: str) -> DataFrame:
    """Per sample the items found there only (specific) and elsewhere too (shared), with percentages."""
    rows = present.select(item, sample).distinct()
    rows = rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(item)))
    out = rows.groupBy(sample).agg(F.count_if(F.col("__n") > 1).alias("shared"), F.count_if(F.col("__n") == 1).alias("specific"))
    total = F.col("shared") + F.col("specific")
    return out.withColumns({"shared_pct": F.col("shared") * 100.0 / total, "specific_pct": F.col("specific") * 100.0 / total})


def spectrum(freq: DataFrame, n: int) -> DataFrame:
    """Items by number of samples, 1 to n, with zeros."""
    axis = freq.sparkSession.range(1, n + 1).select(F.col("id").cast("bigint").alias("n_samples"))
    return axis.join(freq.groupBy("n_samples").agg(F.count(F.lit(1)).alias("items")), "n_samples", "left").na.fill(0, ["items"])


def category(n_samples: Column, n: int, soft: int) -> Column:
    """Core (all samples), Softcore (at least ``soft``), Private (one), Dispensable (the rest)."""
    return F.when(n_samples == n, "Core").when(n_samples >= soft, "Softcore").when(n_samples == 1, "Private").otherwise("Dispensable")


def category_summary(freq: DataFrame, n: int, soft: int) -> DataFrame:
    """Items and percentage of each category; those without items come out with 0."""
    spark = freq.sparkSession
    kinds = spark.createDataFrame([("Core", 1), ("Softcore", 2), ("Dispensable", 3), ("Private", 4)], "category string, ord int")
    have = freq.groupBy(category(F.col("n_samples"), n, soft).alias("category")).agg(F.count(F.lit(1)).alias("items"))
    out = kinds.join(have, "category", "left").na.fill(0, ["items"])
    return out.withColumn("pct", F.coalesce(F.try_divide(F.col("items") * 100.0, F.sum("items").over(Window.partitionBy(F.lit(0)))), F.lit(0.0))).drop("ord")


def orthology_class(counts: Column, target: Column) -> Column:
    """Class of a family from its copy numbers in all species and in the target species: single (one
    copy everywhere), unique (in the target only), multi (several copies everywhere), other or absent."""
    n_with = F.size(F.filter(counts, lambda c: c > 0))
    return F.when(F.forall(counts, lambda c: c == 1), "single").when((target > 0) & (n_with == 1), "unique").when(F.forall(counts, lambda c: c > 1), "multi").when(target > 0, "other").otherwise("absent")


def masks(present: DataFrame, item: str, ordinal: str) -> DataFrame:
    """(item, mask): bit i set if the item is present in the sample with ordinal i.

    Ordinals are 0 to 62; any other fails at run time, as its bit would wrap around.
    """
    o = F.col(ordinal).cast("int")
    fits = F.assert_true(o.between(0, 62), F.concat(F.lit("no bit for sample ordinal "), F.coalesce(o.cast("string"), F.lit("null"))))
    return present.groupBy(item).agg(F.bit_or(F.when(fits.isNull(), F.expr(f"shiftleft(1L, cast({ordinal} as int))"))).alias("mask"))


def mask_jaccard(a: Column, b: Column, least: int = 1) -> Column:
    """Jaccard of two sample sets; null if either has fewer than ``least`` samples."""
    ok = (F.bit_count(a) >= least) & (F.bit_count(b) >= least)
    return F.when(ok, F.try_divide(F.bit_count(a.bitwiseAND(b)), F.bit_count(a.bitwiseOR(b))))


def _choose(n: int, k: int) -> float:
    return float(math.comb(n, k)) if 0 <= k <= n else 0.0


def pan_core_exact(freq: DataFrame, n: int) -> DataFrame:
    """Expected pan and core size of k random samples, k = 1 to n: k, pan, core.

    Items are first counted by frequency, so the sums run over at most n rows.
    """
    spark = freq.sparkSession
    weights = [(k, s, 1.0 - _choose(n - s, k) / _choose(n, k), _choose(s, k) / _choose(n, k)) for k in range(1, n + 1) for s in range(1, n + 1)]
    table = spark.createDataFrame(weights, "k int, n_samples bigint, pan_w double, core_w double")
    counts = freq.groupBy("n_samples").agg(F.count(F.lit(1)).alias("items"))
    return table.join(F.broadcast(counts), "n_samples").groupBy("k").agg(F.sum(F.col("items") * F.col("pan_w")).alias("pan"), F.sum(F.col("items") * F.col("core_w")).alias("core"))


def pan_core_subsets(item_masks: DataFrame, n: int, subsets: list[int]) -> DataFrame:
    """Pan and core size of given sample subsets (bit masks): subset, k, pan, core.

    Items are reduced to distinct masks with counts; the subsets are a stated list that is exploded
    in blocks against them, with partial sums per block.
    """
    counts = item_masks.groupBy("mask").agg(F.count(F.lit(1)).alias("items"))
    block = 4096
    out = None
    for at in range(0, len(subsets), block):
        part = counts.withColumn("subset", F.explode(F.array(*(F.lit(s).cast("bigint") for s in subsets[at : at + block]))))
        hit = F.col("mask").bitwiseAND(F.col("subset"))
        got = part.groupBy("subset").agg(F.sum(F.when(hit != 0, F.col("items")).otherwise(0)).alias("pan"), F.sum(F.when(hit == F.col("subset"), F.col("items")).otherwise(0)).alias("core"))
        out = got if out is None else out.unionByName(got)
    return out.select("subset", F.bit_count("subset").cast("int").alias("k"), "pan", "core")


def pan_core_exhaustive(item_masks: DataFrame, n: int) -> DataFrame:
    """Pan and core size of all 2^n - 1 subsets, by a subset-sum (zeta) transform.

    Level by level, one bit at a time: f(S) = sum of items whose mask lies within S, and g(S) = sum of
    items whose mask contains S. The table has 2^n rows, so n is limited to 20.
    """
    if n > 20:
        raise ValueError("at most 20 samples")
    spark = item_masks.sparkSession
    counts = item_masks.groupBy("mask").agg(F.count(F.lit(1)).alias("items"))
    grid = spark.range(1 << n).select(F.col("id").alias("subset")).join(counts, F.col("subset") == F.col("mask"), "left").select("subset", F.coalesce("items", F.lit(0)).alias("within"), F.coalesce("items", F.lit(0)).alias("over"))
    for i in range(n):
        # a row and its partner, which differ in bit i, meet in one group
        bit = 1 << i
        has = F.col("subset").bitwiseAND(F.lit(bit)) != 0
        pairs = grid.groupBy(F.col("subset").bitwiseAND(F.lit(~bit)).alias("base")).agg(
            F.sum(F.when(~has, F.col("within"))).alias("w0"), F.sum(F.when(has, F.col("within"))).alias("w1"), F.sum(F.when(~has, F.col("over"))).alias("o0"), F.sum(F.when(has, F.col("over"))).alias("o1")
        )
        grid = pairs.select(
            F.inline(
                F.array(
                    F.struct(F.col("base").alias("subset"), F.col("w0").alias("within"), (F.col("o0") + F.col("o1")).alias("over")),
                    F.struct(F.col("base").bitwiseOR(F.lit(bit)).alias("subset"), (F.col("w0") + F.col("w1")).alias("within"), F.col("o1").alias("over")),
                )
            )
        )
    whole = F.lit((1 << n) - 1)
    # items present somewhere in S = all items less those within the complement of S
    comp = grid.select(whole.bitwiseXOR(F.col("subset")).alias("subset"), F.col("within").alias("outside"))
    every = item_masks.agg(F.count(F.lit(1)).alias("every"))
    joined = grid.where("subset <> 0").join(comp, "subset").join(F.broadcast(every))
    return joined.select("subset", F.bit_count("subset").cast("int").alias("k"), (F.col("every") - F.col("outside")).alias("pan"), F.col("over").alias("core"))


def random_subsets(n: int, per_size: int, seed: int) -> list[int]:
    """Distinct random sample subsets of every size, as masks; all of a size if there are no more."""
    rng = random.Random(seed)
    out: list[int] = []
    for k in range(1, n + 1):
        seen: set[int] = set()
        for _ in range(per_size * 20):
            if len(seen) >= min(per_size, math.comb(n, k)):
                break
            seen.add(sum(1 << i for i in rng.sample(range(n), k)))
        out += sorted(seen)
    return out


def curve_summary(curves: DataFrame) -> DataFrame:
    """Mean, median, least and greatest pan and core size by subset size."""
    return curves.groupBy("k").agg(*(f(c).alias(f"{c}_{n}") for c in ("pan", "core") for n, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))))


def list_cell_sizes(cell: Column, sep: str = ",") -> Column:
    """Number of non-empty entries of a list cell."""
    return F.size(F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != ""))


def low_copy(counts: DataFrame, family: str, species: str, n: str, species_total: int, most: int = 5) -> DataFrame:
    """Families with 1 to ``most`` copies in every species; a species without a row has none."""
    g = counts.groupBy(family).agg(F.count_distinct(F.when(F.col(n) > 0, F.col(species))).alias("s"), F.max(n).alias("m"))
    return g.where((F.col("s") == species_total) & (F.col("m") <= most)).select(family)
