"""Statistics: quantiles, ranks, correlation, tests, resampling, densities."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def linear_quantile(value: Column | str, q: float) -> Column:
    """Aggregate: quantile with linear interpolation at (n - 1) * q."""
    return F.percentile(value, F.lit(q))


def nearest_rank(value: str, q: float) -> Column:
    """Aggregate: the value at rank ceil(n * q)."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")


def running_totals(counts: DataFrame, keys: list[str], value: str, count: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``count`` over the rows of the keys up to the row's ``value``.

    Rows (one per keys and value) are range-partitioned and summed within a partition; sums of the
    partitions in front are added. So no task gets all values of a key, nor all rows where there is none.
    """
    from loomspan.runtime import Stored

    ranged = counts.repartitionByRange(*keys, value).withColumn("__p", F.spark_partition_id())
    kept = Stored(ranged, "ranged").df
    here = Window.partitionBy("__p", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    parts = kept.groupBy("__p", *keys).agg(F.sum(count).alias("__c"))
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1) if keys else Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("__p").alias("__q"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__b"))
    on = F.col("__p") == F.col("__q")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    summed = kept.withColumn(out, F.sum(count).over(here)).join(parts, on)
    return summed.withColumn(out, F.col(out) + F.col("__b")).drop("__p", "__q", "__b", *(f"__k{i}" for i in range(len(keys))))


def group_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation at (n - 1) * q per keys, one column per entry of ``qs``.

    Values are counted first; the two values around a quantile are then found by running counts, so
    that no task holds the values of a group. Groups without values give no row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    ranked = running_totals(counts, keys, value, "__c", "__u")
    n = ranked.groupBy(*(F.col(k).alias(f"__g{i}") for i, k in enumerate(keys))).agg(F.max("__u").alias("__n"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__g{i}"))
    met = ranked.join(n, on) if keys else ranked.join(F.broadcast(n))

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("__u") - F.col("__c") <= index) & (index < F.col("__u")), F.col(value).cast("double")))

    aggs = []
    for name, q in qs.items():
        pos = (F.col("__n") - 1) * F.lit(q)
        aggs += [at(F.floor(pos)).alias(f"__lo_{name}"), at(F.ceil(pos)).alias(f"__hi_{name}"), F.max(pos - F.floor(pos)).alias(f"__w_{name}")]
    out = met.groupBy(*keys).agg(*aggs) if keys else met.agg(*aggs)
    return out.select(*keys, *((F.col(f"__lo_{x}") + (F.col(f"__hi_{x}") - F.col(f"__lo_{x}")) * F.col(f"__w_{x}")).alias(x) for x in qs))


def average_rank(df: DataFrame, keys: list[str], value: str, name: str = "avg_rank") -> DataFrame:
    """Adds the mean rank of ties. Distinct values are counted and summed up in ranges; the ranks come
    back by a join on (keys, value)."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    ranks = running_totals(counts, keys, value, "__c", name).withColumn(name, F.col(name) - (F.col("__c") - 1) / 2.0).drop("__c")
    return df.join(ranks, [*keys, value], "left") if not keys else df.join(ranks, [*keys, value])


def correlation(x: Column | str, y: Column | str) -> Column:
    """Aggregate: Pearson correlation over rows with both values; null where either doesn't vary."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation per keys over rows with both values, ties at their mean rank."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(known, keys, x, "__rx"), keys, y, "__ry")
    return ranked.groupBy(*keys).agg(correlation("__rx", "__ry").alias("spearman"), F.count(F.lit(1)).alias("n"))


def pearson_distance(x: str, y: str) -> Column:
    """Aggregate: 1 - correlation; null where either side doesn't vary."""
    return 1.0 - correlation(x, y)


def erfc(x: Column) -> Column:
    """Complementary error function by a Chebyshev fit, relative error below 1.2e-7."""
    z = F.abs(x)
    t = 1.0 / (1.0 + 0.5 * z)
    # fixed values: coefficients of the published fit, from the highest power down
    coefficients = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)
    poly = F.lit(coefficients[0])
    for c in coefficients[1:]:
        poly = poly * t + c
    tail = t * F.exp(-z * z + poly)
    return F.when(x >= 0, tail).otherwise(2.0 - tail)


def mann_whitney(df: DataFrame, keys: list[str], group: str, first: str, second: str, value: str) -> DataFrame:
    """Mann-Whitney U of two groups per keys: n1, n2, u (of ``first``), z with tie and continuity
    correction, and the two-sided normal p. A key with one group only gets null z and p."""
    rows = df.where(F.col(group).isin(first, second) & F.col(value).isNotNull())
    counts = rows.groupBy(*keys, value).agg(F.count_if(F.col(group) == first).alias("a"), F.count(F.lit(1)).alias("c"))
    ranked = running_totals(counts, keys, value, "c", "u").withColumn("r", F.col("u") - (F.col("c") - 1) / 2.0)
    g = ranked.groupBy(*keys).agg(F.sum("a").alias("n1"), (F.sum("c") - F.sum("a")).alias("n2"), F.sum(F.col("a") * F.col("r")).alias("__r1"), F.sum(F.pow(F.col("c").cast("double"), F.lit(3.0)) - F.col("c")).alias("__t"))
    n = F.col("n1") + F.col("n2")
    u = F.col("__r1") - F.col("n1") * (F.col("n1") + 1) / 2.0
    mu = F.col("n1") * F.col("n2") / 2.0
    var = F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.try_divide(F.col("__t"), (n * (n - 1)).cast("double")))
    z = F.when(var > 0, F.greatest(F.abs(u - mu) - 0.5, F.lit(0.0)) / F.sqrt(var))
    return g.withColumns({"u": u, "z": z}).withColumn("p", F.least(erfc(F.col("z") / F.lit(2.0**0.5)), F.lit(1.0))).drop("__r1", "__t")


#: Rows of a batch that are weighed at once: a batch takes so many times the rounds in memory.
BOOT_ROWS = 512
# fixed values: the multipliers of the splitmix64 generator
_GOLDEN, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _poisson_cuts(most: int = 8) -> list[float]:
    """Distribution function of Poisson(1) at 0 to ``most`` - 1."""
    cuts, p, term = [], 0.0, math.exp(-1)
    for k in range(most):
        p += term
        cuts.append(p)
        term /= k + 1
    return cuts


def _weights(ident: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """Poisson(1) weight of each row (uint64 ident) in each round, from splitmix64 of ident, seed and round."""
    with np.errstate(over="ignore"):
        start = np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(_GOLDEN) + np.uint64(seed) * np.uint64(_MIX2)
        z = ident[:, None] * np.uint64(_MIX1) + start[None, :]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(_MIX1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(_MIX2)
        z ^= z >> np.uint64(31)
    return np.searchsorted(_poisson_cuts(), (z >> np.uint64(11)) * 2.0**-53, side="right").astype(np.float64)


def bootstrap_sums(df: DataFrame, keys: list[str], ident: list[str], values: list[str], rounds: int, seed: int = 1) -> DataFrame:
    """Sums of Poisson resampling: keys, ``round`` (from 1), ``w`` and, per value and per pair of values in
    order, ``s_<i>`` and ``s_<i>_<j>``.

    A row's weight in a round is Poisson(1), from a hash of ``ident``, the columns that tell rows apart,
    so it is the same in every run and partitioning. A task adds all rounds of its rows up as arrays; one
    row per keys, round and task travels. Rows with a null value don't count.
    """
    own = [f"k{i}" for i in range(len(keys))]
    types = dict(df.dtypes)
    number = F.col(ident[0]).cast("bigint") if len(ident) == 1 and types[ident[0]] in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(*ident)
    base = df.select(*(F.col(k).alias(o) for k, o in zip(keys, own)), number.alias("id"), *(F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values))).dropna(subset=[f"v{i}" for i in range(len(values))])
    pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for part in parts:
            groups = part.groupby(own, dropna=False, sort=False).indices.items() if own else [((), np.arange(len(part)))]
            ids = part["id"].to_numpy().astype(np.int64).view(np.uint64)
            vals = np.stack([part[f"v{i}"].to_numpy(dtype=float) for i in range(len(values))])
            for key, rows in groups:
                key = key if isinstance(key, tuple) else (key,)
                total = sums.setdefault(tuple(None if k != k else k for k in key), np.zeros((1 + len(values) + len(pairs), rounds)))
                for at in range(0, len(rows), BOOT_ROWS):
                    r = rows[at : at + BOOT_ROWS]
                    x = vals[:, r]
                    total += np.vstack([np.ones(len(r)), x, *(x[i] * x[j] for i, j in pairs)]) @ _weights(ids[r], rounds, seed)
        for key, total in sums.items():
            out = {o: [k] * rounds for o, k in zip(own, key)}
            out["round"] = np.arange(1, rounds + 1)
            yield pd.DataFrame({**out, **{c: total[i] for i, c in enumerate(names)}})

    names = ["w", *(f"s_{i}" for i in range(len(values))), *(f"s_{i}_{j}" for i, j in pairs)]
    kinds = dict(base.dtypes)
    ddl = "".join(f"{o} {kinds[o]}, " for o in own) + "round int, " + ", ".join(f"{n} double" for n in names)
    summed = base.mapInPandas(run, ddl).groupBy(*own, "round").agg(*(F.sum(n).alias(n) for n in names))
    return summed.select(*(F.col(o).alias(k) for o, k in zip(own, keys)), "round", *names)


def bootstrap_mean(df: DataFrame, keys: list[str], value: str, rounds: int = 1000, seed: int = 1, ident: list[str] | None = None) -> DataFrame:
    """95 % interval of the mean by Poisson resampling: keys, ``lo``, ``hi``; see ``bootstrap_sums``.

    ``ident`` names the columns that tell rows apart, by default all.
    """
    sums = bootstrap_sums(df, keys, ident or df.columns, [value], rounds, seed).withColumn("m", F.try_divide("s_0", "w"))
    return sums.groupBy(*keys).agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))


def bootstrap_distance(df: DataFrame, keys: list[str], x: str, y: str, rounds: int = 1000, seed: int = 1, ident: list[str] | None = None) -> DataFrame:
    """Pearson distance of every group, by compartment or whatever the keys are, with its resampling:
    keys, ``n``, ``distance``, ``mean``, ``lo`` and ``hi`` of the rounds, and ``rounds``, those where both sides vary."""
    sums = bootstrap_sums(df, keys, ident or df.columns, [x, y], rounds, seed)
    w, sx, sy, sxx, sxy, syy = (F.col(c) for c in ("w", "s_0", "s_1", "s_0_0", "s_0_1", "s_1_1"))
    vx, vy = sxx / w - (sx / w) * (sx / w), syy / w - (sy / w) * (sy / w)
    d = F.when((w > 1) & (vx > 1e-12 * F.abs(sxx / w)) & (vy > 1e-12 * F.abs(syy / w)), 1.0 - (sxy / w - sx * sy / (w * w)) / F.sqrt(vx * vy))
    boot = sums.withColumn("d", d).groupBy(*keys).agg(F.avg("d").alias("mean"), F.percentile("d", F.lit(0.025)).alias("lo"), F.percentile("d", F.lit(0.975)).alias("hi"), F.count("d").alias("rounds"))
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson_distance(x, y).alias("distance"))
    return known.join(boot, keys) if keys else known.join(F.broadcast(boot))


def empirical_p(df: DataFrame, keys: list[str], random_value: str, observed: str) -> DataFrame:
    """(number of random values >= observed + 1) / (n + 1), z by the population sd, 95th percentile."""
    g = df.groupBy(*keys).agg(F.count_if(F.col(random_value) >= F.col(observed)).alias("ge"), F.count(random_value).alias("n"), F.avg(random_value).alias("mean"), F.stddev_pop(random_value).alias("sd"), F.percentile(random_value, F.lit(0.95)).alias("p95"), F.max(observed).alias("observed"))
    return g.withColumns({"p": (F.col("ge") + 1) / (F.col("n") + 1), "z": F.when(F.col("sd") > 0, (F.col("observed") - F.col("mean")) / F.col("sd"))})


def kde(df: DataFrame, keys: list[str], value: str, lo: float, hi: float, points: int, bandwidth: float) -> DataFrame:
    """Gaussian density on an even grid. Values are first binned to a hundredth of the bandwidth, so the
    grid meets distinct bins, not rows."""
    step = bandwidth / 100
    bins = df.where(F.col(value).isNotNull()).groupBy(*keys, (F.round(F.col(value) / step) * step).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(lo) + i * ((hi - lo) / (points - 1)))
    at = bins.withColumn("x", F.explode(grid))
    z = (F.col("x") - F.col("v")) / bandwidth
    dens = at.groupBy(*keys, "x").agg((F.sum(F.col("c") * F.exp(-0.5 * z * z)) / F.sum("c") / (bandwidth * (2 * 3.141592653589793) ** 0.5)).alias("density"))
    return dens


def peak(df: DataFrame, keys: list[str], x: str, y: str, lo: float, hi: float, trough: bool = False) -> DataFrame:
    """The x with the greatest (or least) y in [lo, hi]; ties to the lower x."""
    rows = df.where(F.col(x).between(lo, hi))
    w = Window.partitionBy(*keys).orderBy(F.asc(y) if trough else F.desc(y), x)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def genome_size(histo: DataFrame, keys: list[str], depth: str, count: str, least_depth: int = 5, radius: int = 2) -> DataFrame:
    """Genome sizes from a k-mer spectrum: all, from depth 2 and from depth 3 on, over the peak depth.

    Result: keys, ``peak``, ``size_all``, ``size_ge2``, ``size_ge3`` (null without a peak), ``rule``. The
    peak is the highest local maximum of the spectrum, smoothed over the depths that occur, from
    ``least_depth`` on (ties to the lower depth); of the next eleven maxima, the highest that lies at
    1.75 to 2.25 times its depth with 8 % of its height or more, the homozygous peak, counts instead.
    """
    d, c = F.col(depth), F.col(count)
    totals = histo.groupBy(*keys).agg(*(F.sum(F.when(d >= i, d * c).otherwise(0)).alias(f"__t{i}") for i in (0, 2, 3)))
    w = Window.partitionBy(*keys).orderBy(depth)
    rows = histo.where((d >= least_depth) & (c > 0)).withColumn("__y", F.avg(count).over(w.rowsBetween(-radius, radius)))
    rows = rows.withColumns({"__p": F.coalesce(F.lag("__y").over(w), F.lit(-1.0)), "__n": F.coalesce(F.lead("__y").over(w), F.lit(-1.0))})
    maxima = rows.where((F.col("__y") >= F.col("__p")) & (F.col("__y") >= F.col("__n"))).withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__y"), depth)))
    whole = Window.partitionBy(*keys)
    top = maxima.where("__rank <= 12").withColumns({"__d1": F.max(F.when(F.col("__rank") == 1, d)).over(whole), "__y1": F.max(F.when(F.col("__rank") == 1, F.col("__y"))).over(whole)})
    double = (F.col("__rank") > 1) & d.between(1.75 * F.col("__d1"), 2.25 * F.col("__d1")) & (F.col("__y") >= 0.08 * F.col("__y1"))
    best = top.groupBy(*keys).agg(F.min(F.when(double, F.struct("__rank", d.alias("d")))).getField("d").alias("__d2"), F.max("__d1").alias("__d1"))
    out = (totals.join(best, keys, "left") if keys else totals.join(best)).withColumn("peak", F.coalesce("__d2", "__d1"))
    rule = F.when(F.col("__d2").isNotNull(), "higher_depth_peak_near_2x_top").when(F.col("__d1").isNotNull(), "highest_smoothed_peak").otherwise("no_peak_after_min_depth")
    return out.select(*keys, "peak", *(F.rint(F.col(f"__t{i}") / F.col("peak")).alias(n) for i, n in ((0, "size_all"), (2, "size_ge2"), (3, "size_ge3"))), rule.alias("rule"))


def size_frequencies(df: DataFrame, length: str, n_samples: str, samples: int) -> DataFrame:
    """Events by size class and number of samples: size_class, n_samples, events, class_events, share.

    Every class comes out with every number from 1 to ``samples``. Events of under 50 bp, or in no
    sample, don't count; the share of an empty class is null.
    """
    from loomspan.functions.scalars import SIZE_CLASSES, size_class

    known = df.select(size_class(F.col(length)).alias("size_class"), F.col(n_samples).cast("bigint").alias("n_samples")).where("size_class is not null and n_samples > 0")
    counts = known.groupBy("size_class", "n_samples").agg(F.count(F.lit(1)).alias("events"))
    grid = df.sparkSession.range(1, samples + 1).select(F.explode(F.array(*(F.lit(s) for s in SIZE_CLASSES))).alias("size_class"), F.col("id").alias("n_samples"))
    out = grid.join(counts, ["size_class", "n_samples"], "left").na.fill(0, ["events"])
    whole = F.sum("events").over(Window.partitionBy("size_class"))
    return out.withColumn("class_events", whole).withColumn("share", F.try_divide(F.col("events").cast("double"), F.col("class_events")))


def pairwise_identity(aligned: DataFrame, name: str, seq: str, both: bool = True, most: int = 2000) -> DataFrame:
    """Share of equal columns of every unordered pair of aligned sequences of one alignment.

    Columns with a gap in both, or with ``both`` in either, don't count. An alignment is a stated,
    small set of rows (at most ``most``, else an error); pairs are made once (a < b) and counted in place.
    """
    if aligned.limit(most + 1).count() > most:
        raise ValueError(f"an alignment of over {most} sequences")
    b = aligned.select(F.col(name).alias("b"), F.col(seq).alias("sb"))
    pairs = aligned.select(F.col(name).alias("a"), F.col(seq).alias("sa")).join(b, F.col("a") < F.col("b"))
    cols = F.zip_with(F.split("sa", ""), F.split("sb", ""), lambda x, y: F.when(((x == "-") | (y == "-")) if both else ((x == "-") & (y == "-")), F.lit(None)).when(x == y, 1).otherwise(0))
    known = F.filter(cols, lambda x: x.isNotNull())
    return pairs.select("a", "b", F.size(known).alias("columns"), F.try_divide(F.aggregate(known, F.lit(0), lambda s, x: s + x), F.size(known)).alias("identity"))


def consensus(aligned: DataFrame, keys: list[str], seq: str, share: float = 0.5, unknown: str = "N") -> DataFrame:
    """Majority base of every column, or ``unknown`` below the share; ties to the lesser base."""
    at = aligned.select(*keys, F.posexplode(F.split(F.upper(seq), "")).alias("pos", "base")).where("base <> ''")
    n = at.groupBy(*keys, "pos", "base").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys, "pos")
    top = n.withColumns({"all": F.sum("n").over(w), "rn": F.row_number().over(w.orderBy(F.desc("n"), "base"))}).where("rn = 1")
    call = top.withColumn("base", F.when(F.col("n") >= F.col("all") * share, F.col("base")).otherwise(unknown))
    return call.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("consensus"))


def nucleotide_diversity(aligned: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Mean pairwise difference per column, from base counts per column: no pairs are made."""
    at = aligned.select(*keys, F.posexplode(F.split(F.upper(seq), "")).alias("pos", "base")).where("base in ('A','C','G','T')")
    n = at.groupBy(*keys, "pos", "base").agg(F.count(F.lit(1)).alias("n"))
    col = n.groupBy(*keys, "pos").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    pi = F.when(F.col("m") > 1, 1.0 - F.col("same") / (F.col("m") * (F.col("m") - 1)))
    return col.groupBy(*keys).agg(F.avg(pi).alias("pi"), F.count(pi).alias("sites"))


def best_pair_similarity(hits: DataFrame, a: str, b: str, identity: str, covered: str, len_a: str, len_b: str, least: float) -> DataFrame:
    """Greatest identity per unordered pair among hits that cover ``least`` of the shorter sequence."""
    ok = hits.where((F.col(a) != F.col(b)) & (F.col(covered) >= least * F.least(F.col(len_a), F.col(len_b))))
    return ok.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.max(identity).alias("identity"))


def threshold_grid(df: DataFrame, keys: list[str], settings: list[tuple[float, float]], length: str, identity: str, forward: Column) -> DataFrame:
    """Support under several (length, identity) thresholds: 'both', 'forward', 'reverse' or 'none', and
    the number of settings with both. Settings are a stated list; each adds columns, not rows."""
    aggs = []
    for i, (ln, idt) in enumerate(settings):
        ok = (F.col(length) >= ln) & (F.col(identity) >= idt)
        aggs += [F.count_if(ok & forward).alias(f"__f{i}"), F.count_if(ok & ~forward).alias(f"__r{i}")]
    g = df.groupBy(*keys).agg(*aggs)
    label = lambda i: F.when((F.col(f"__f{i}") > 0) & (F.col(f"__r{i}") > 0), "both").when(F.col(f"__f{i}") > 0, "forward").when(F.col(f"__r{i}") > 0, "reverse").otherwise("none")
    n = len(settings)
    both = sum(((F.col(f"__f{i}") > 0) & (F.col(f"__r{i}") > 0)).cast("int") for i in range(n))
    return g.select(*keys, *(label(i).alias(f"support_{i}") for i in range(n)), both.alias("settings_both"))


def _linkage_order(names: list, d: np.ndarray) -> list:
    """Leaves of the average-linkage tree of a distance matrix, by nearest-neighbour chains."""
    n = len(names)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, alive, merges, chain = np.ones(n), np.ones(n, dtype=bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            x = chain[-1]
            row = np.where(alive, d[x], np.inf)
            row[x] = np.inf
            y = chain[-2] if len(chain) > 1 and row[chain[-2]] == row.min() else int(row.argmin())
            if len(chain) > 1 and y == chain[-2]:
                break
            chain.append(y)
        chain = chain[:-2]
        merges.append((d[x, y], min(x, y), max(x, y)))
        mean = (size[x] * d[x] + size[y] * d[y]) / (size[x] + size[y])
        keep, gone = max(x, y), min(x, y)
        d[keep], d[:, keep] = mean, mean
        d[keep, keep] = np.inf
        size[keep] += size[gone]
        alive[gone] = False
    # merges in order of height get the numbers n, n + 1, ...; the lower number is the left child
    top = {i: i for i in range(n)}
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    children = []
    for i, (_, x, y) in enumerate(sorted(merges, key=lambda m: m[0])):
        a, b = root(x), root(y)
        children.append(sorted((top[a], top[b])))
        parent[a] = b
        top[b] = n + i
    order, todo = [], [n + len(children) - 1 if children else 0]
    while todo:
        at = todo.pop()
        if at < n:
            order.append(names[at])
        else:
            left, right = children[at - n]
            todo += [right, left]
    return order


def leaf_order(pairs: DataFrame, a: str, b: str, distance: str, most: int = 2000) -> DataFrame:
    """Order of the leaves of the average-linkage tree of one matrix: (leaf, pos), pos from 1.

    ``pairs`` gives a distance once per unordered pair, in either direction; a missing pair has the
    greatest distance. The matrix is a stated, small set of at most ``most`` names, else an error, and
    is clustered by one task. Equal heights go by the names' order.
    """
    kind = dict(pairs.dtypes)[a]
    known = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(distance).cast("double").alias("d"))
    names = known.select(F.explode(F.array("a", "b")).alias("x")).distinct()
    if names.limit(most + 1).count() > most:
        raise ValueError(f"a matrix of over {most} names")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf["a"], *pdf["b"]})
        at = {x: i for i, x in enumerate(names)}
        d = np.full((len(names), len(names)), pdf["d"].max())
        i, j = pdf["a"].map(at).to_numpy(), pdf["b"].map(at).to_numpy()
        d[i, j] = d[j, i] = pdf["d"].to_numpy()
        order = _linkage_order(names, d)
        return pd.DataFrame({"leaf": order, "pos": range(1, len(order) + 1)})

    return known.groupBy().applyInPandas(run, f"leaf {kind}, pos int")
