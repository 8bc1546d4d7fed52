"""Operators composed of the basic ones: annotation filters, repeat summaries, projections, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.intervals import Span, lift_over, overlap_join, overlap_semi
from loomspan.operators.islands import merge_islands, union_length
from loomspan.operators.signal import weighted_mean


def per_type_filter(kind: Column, rules: dict[str, Column], relaxed: Column | None = None, other: bool = False) -> Column:
    """The rule of a row's type decides; ``relaxed`` rows pass whatever it says; unlisted types get ``other``."""
    out = F.lit(other)
    for name, rule in rules.items():
        out = F.when(kind == name, F.coalesce(rule, F.lit(False))).otherwise(out)
    return out | F.coalesce(relaxed, F.lit(False)) if relaxed is not None else out


def upstream_supported(cds: DataFrame, introns: DataFrame, starts: DataFrame, chrom: str, start: str, end: str, strand: str) -> DataFrame:
    """CDS rows whose 5' end abuts an intron's end or equals a start codon's; same chromosome and strand.

    All three have the same column names, coordinates 1-based closed.
    """
    plus = F.col(strand) == "+"
    at = cds.withColumn("__five", F.when(plus, F.col(start)).otherwise(F.col(end)))
    i = introns.select(F.col(chrom).alias("__c"), F.col(strand).alias("__s"), F.when(plus, F.col(end) + 1).otherwise(F.col(start) - 1).alias("__p"))
    s = starts.select(F.col(chrom).alias("__c"), F.col(strand).alias("__s"), F.when(plus, F.col(start)).otherwise(F.col(end)).alias("__p"))
    marks = i.unionByName(s).distinct()
    return at.join(marks, (F.col(chrom) == F.col("__c")) & (F.col(strand) == F.col("__s")) & (F.col("__five") == F.col("__p")), "left_semi").drop("__five")


def demote(df: DataFrame, source: str, supported: Column, alone: list[str], combined: dict[str, str]) -> DataFrame:
    """Adds ``decision`` and ``new_source`` by what is left of a row's support.

    Rows of a source in ``alone`` are dropped; rows of a combined source are kept as they are if they
    are still ``supported``, else demoted to the source that ``combined`` names; others are kept. Rows
    to drop stay in the result, so that rejects can be reported.
    """
    ok = F.coalesce(supported, F.lit(False))
    base = F.lit(None).cast("string")
    for name, rest in combined.items():
        base = F.when(F.col(source) == name, rest).otherwise(base)
    decision = F.when(F.col(source).isin(alone), "drop").when(base.isNotNull() & ~ok, "demote").otherwise("keep")
    return df.withColumns({"decision": decision, "new_source": F.when(base.isNotNull() & ~ok, base).otherwise(F.col(source))})


def solo_elements(elements: DataFrame, complete: DataFrame, internal: DataFrame, key: str, start: str, end: str, row_id: str, least: int = 100, flank: int = 20_000) -> DataFrame:
    """Every element with ``reason``: 'short', 'in_complete' (overlaps a complete one), 'near_internal'
    (an internal part within ``flank``), or 'solo'; the first that holds."""
    span = Span(start, end)
    base = elements.withColumn("__short", F.col(end) - F.col(start) < least)
    hit = overlap_semi(base, complete, [(key, key)], span, span, row_id).select(row_id, F.lit(1).alias("__full"))
    near = overlap_semi(base, internal, [(key, key)], span, span, row_id, slack=flank).select(row_id, F.lit(1).alias("__int"))
    out = base.join(hit, row_id, "left").join(near, row_id, "left")
    return out.withColumn("reason", F.when(F.col("__short"), "short").when(F.col("__full") == 1, "in_complete").when(F.col("__int") == 1, "near_internal").otherwise("solo")).drop("__short", "__full", "__int")


def lock_step(frames: dict[str, DataFrame], key: str, values: list[str]) -> DataFrame:
    """Several inputs side by side by record id, columns as <input>_<value>; an id missing from any input
    fails at run time."""
    parts = [df.select(key, *(F.col(v).alias(f"{n}_{v}") for v in values), F.lit(1).alias(f"__{n}")) for n, df in frames.items()]
    out = reduce(lambda a, b: a.join(b, key, "full_outer"), parts)
    whole = reduce(lambda a, b: a & b, [F.col(f"__{n}").isNotNull() for n in frames])
    ok = F.assert_true(whole, F.concat(F.lit("record not in all inputs: "), F.col(key).cast("string")))
    return out.withColumn("__ok", ok).where("__ok is null").drop("__ok", *(f"__{n}" for n in frames))


def choose_cluster(clusters: DataFrame, features: DataFrame, keys: list[str], start: str, end: str, score: str, fspan: Span) -> DataFrame:
    """Per keys the cluster with the greatest (overlap with a feature, score), or without any overlap the
    best by score; ties to the lower start. Adds ``overlap`` and ``guided``."""
    f = features.select(*(F.col(k).alias(f"__f{k}") for k in keys), F.col(fspan.start).alias("__fs"), F.col(fspan.end).alias("__fe"))
    j = overlap_join(clusters, f, [(k, f"__f{k}") for k in keys], Span(start, end), Span("__fs", "__fe", fspan.closed)).groupBy(*clusters.columns).agg(F.sum("overlap").alias("overlap"))
    both = clusters.join(j.select(*keys, start, end, "overlap"), [*keys, start, end], "left").na.fill(0, ["overlap"])
    w = Window.partitionBy(*keys).orderBy(F.desc("overlap"), F.desc(score), start)
    return both.withColumn("guided", F.col("overlap") > 0).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def two_hop(points: DataFrame, first: DataFrame, second: DataFrame, row_id: str, key: str, span: Span) -> DataFrame:
    """Lift through two block tables in turn: row_id, status ('lifted' or why not, with the hop), target, start, end."""
    a = lift_over(points, first, row_id, [(key, "q_name")], span)
    mid = a.where("status = 'lifted'").select(row_id, F.col("t_name").alias("__m"), F.col("lifted_start").alias("__s"), F.col("lifted_end").alias("__e"))
    b = lift_over(mid, second, row_id, [("__m", "q_name")], Span("__s", "__e"))
    out = a.select(row_id, F.col("status").alias("__s1")).join(b.withColumnRenamed("status", "__s2"), row_id, "left")
    return out.select(row_id, F.when(F.col("__s1") != "lifted", F.concat_ws("_", F.lit("first"), "__s1")).when(F.col("__s2") != "lifted", F.concat_ws("_", F.lit("second"), "__s2")).otherwise("lifted").alias("status"), "t_name", "lifted_start", "lifted_end")


def merge_hits(hits: DataFrame, keys: list[str], start: str, end: str, cls: str, gap: int = 100) -> DataFrame:
    """Hits of one element merged over small gaps, with the class that covers most bp (ties by name)."""
    from loomspan.operators.islands import island_ids

    rows = island_ids(hits, keys, start, end, gap, ties=[cls])
    per = rows.groupBy(*keys, "island", cls).agg(F.sum(F.col(end) - F.col(start)).alias("__bp"), F.min(start).alias("__s"), F.max(end).alias("__e"), F.count(F.lit(1)).alias("__n"))
    return per.groupBy(*keys, "island").agg(F.min("__s").alias(start), F.max("__e").alias(end), F.sum("__n").alias("n"), F.min(F.struct(-F.col("__bp"), F.col(cls))).getField(cls).alias(cls)).drop("island")


def track_matrix(windows: DataFrame, key: str, start: str, end: str, tracks: dict[str, tuple[DataFrame, str, str]], values: dict[str, tuple[DataFrame, str, str, str]]) -> DataFrame:
    """One row per window: for each track the covered fraction, for each value table the weighted mean.

    ``tracks``: name -> (intervals, start, end); ``values``: name -> (intervals, start, end, value); all
    carry the column ``key``. Windows without any overlap have 0 and null.
    """
    out = windows
    w = windows.select(F.col(key).alias("__k"), F.col(start).alias("__ws"), F.col(end).alias("__we"))
    for name, (df, s, e) in tracks.items():
        merged = merge_islands(df, [key], s, e)
        j = overlap_join(w, merged, [("__k", key)], Span("__ws", "__we"), Span(s, e)).groupBy("__k", "__ws", "__we").agg(F.sum("overlap").alias("__bp"))
        out = out.join(j.select(F.col("__k").alias(key), F.col("__ws").alias(start), F.col("__we").alias(end), (F.col("__bp") / (F.col("__we") - F.col("__ws"))).alias(name)), [key, start, end], "left").na.fill(0.0, [name])
    for name, (df, s, e, v) in values.items():
        j = overlap_join(w, df.select(key, s, e, v), [("__k", key)], Span("__ws", "__we"), Span(s, e)).groupBy("__k", "__ws", "__we").agg(weighted_mean(F.col(v), F.col("overlap")).alias(name))
        out = out.join(j.select(F.col("__k").alias(key), F.col("__ws").alias(start), F.col("__we").alias(end), name), [key, start, end], "left")
    return out


def protein_profile(proteins: DataFrame, name: str, seq: str, genes: DataFrame, gene: str) -> DataFrame:
    """One row: records, repeated ids, ends with and inner stops, invalid residues, lengths, and ids that
    only the proteins or only the annotation have."""
    s = F.upper(F.col(seq))
    p = proteins.select(F.col(name).alias("__i"), s.alias("__s"), F.length(seq).alias("__n"))
    agg = p.agg(
        F.count(F.lit(1)).alias("records"),
        (F.count(F.lit(1)) - F.count_distinct("__i")).alias("repeated"),
        F.count_if(F.col("__s").rlike(r"[*.]\z")).alias("terminal_stop"),
        F.count_if(F.col("__s").rlike(r"(?s)[*.].")).alias("inner_stop"),
        F.count_if(F.col("__s").rlike("[^ACDEFGHIKLMNPQRSTVWYXBZUO*.]")).alias("invalid"),
        F.min("__n").alias("shortest"),
        F.max("__n").alias("longest"),
        F.percentile("__n", F.lit(0.5)).alias("median_length"),
    )
    g = genes.select(F.col(gene).alias("__g")).distinct()
    ids = p.select("__i").distinct()
    only_p = ids.join(g, F.col("__i") == F.col("__g"), "left_anti").agg(F.count(F.lit(1)).alias("only_proteins"))
    only_g = g.join(ids, F.col("__i") == F.col("__g"), "left_anti").agg(F.count(F.lit(1)).alias("only_genes"))
    return agg.join(F.broadcast(only_p)).join(F.broadcast(only_g))


def repeat_decay(hits: DataFrame, keys: list[str], start: str, end: str, family: str, identity: str, length: Column, gap: int = 20) -> DataFrame:
    """Per keys: fragments, families, merged bp, covered fraction, length-weighted identity, longest fragment."""
    bp = F.col(end) - F.col(start)
    base = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("fragments"), F.count_distinct(family).alias("families"), weighted_mean(F.col(identity), bp).alias("identity"), F.max(bp).alias("longest"), F.max(length).alias("__len"))
    merged = merge_islands(hits, keys, start, end, gap).groupBy(*keys).agg(F.sum(bp).alias("merged_bp"))
    return base.join(merged, keys).withColumn("coverage", F.try_divide(F.col("merged_bp"), F.col("__len"))).drop("__len")


def inside_weight(points: DataFrame, cds: DataFrame, key: str, point: str, start: str, end: str, weight: str, row_id: str) -> DataFrame:
    """Per point the summed weight of the intervals that hold it strictly inside (closed coordinates)."""
    p = points.select(row_id, F.col(key).alias("__k"), F.col(point).alias("__p"), (F.col(point) + 1).alias("__p1"))
    j = overlap_join(p, cds.select(key, start, end, weight), [("__k", key)], Span("__p", "__p1"), Span(start, end, True)).where((F.col(start) < F.col("__p")) & (F.col("__p") < F.col(end)))
    return points.select(row_id).join(j.groupBy(row_id).agg(F.sum(weight).alias("weight")), row_id, "left").na.fill(0, ["weight"])


def pair_share(df: DataFrame, a: str, b: str, matched: Column) -> DataFrame:
    """Matched, total and percentage per ordered pair."""
    return df.groupBy(a, b).agg(F.count_if(matched).alias("matched"), F.count(F.lit(1)).alias("total")).withColumn("pct", F.col("matched") * 100.0 / F.col("total"))


def scope_fraction(df: DataFrame, keys: list[str], start: str, end: str, genome_bp: int) -> DataFrame:
    """One row: bp of the union of the intervals of each key, summed, and their share of the genome."""
    merged = union_length(df, keys, start, end)
    return merged.agg(F.coalesce(F.sum("bp"), F.lit(0)).alias("bp")).withColumn("fraction", F.col("bp") / F.lit(genome_bp))


def expression_divergence(expr: DataFrame, gene: str, group: str, a: str, b: str, value: str, least: float = 1.0) -> DataFrame:
    """Per gene expressed in either group: mean of both groups, log2 fold change and its size."""
    g = expr.groupBy(gene).agg(F.avg(F.when(F.col(group) == a, F.col(value))).alias("mean_a"), F.avg(F.when(F.col(group) == b, F.col(value))).alias("mean_b")).na.fill(0.0, ["mean_a", "mean_b"])
    g = g.where((F.col("mean_a") >= least) | (F.col("mean_b") >= least))
    fc = F.log2(F.col("mean_a") + 1.0) - F.log2(F.col("mean_b") + 1.0)
    return g.withColumns({"log2fc": fc, "abs_log2fc": F.abs(fc)})


def region_to_contig(df: DataFrame, regions: DataFrame, region: str, offset: str, start: str, end: str) -> DataFrame:
    """Coordinates in a region shifted to its contig."""
    r = regions.select(F.col(region).alias("__r"), F.col(offset).alias("__o"), *(c for c in regions.columns if c not in (region, offset)))
    return df.join(r, F.col(region) == F.col("__r")).withColumns({start: F.col(start) + F.col("__o"), end: F.col(end) + F.col("__o")}).drop("__r", "__o")
