"""Matching of records between two sets: scored candidates, reciprocal best hits, capped evidence."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The smaller of the two overlap fractions of half-open intervals; 0 for an empty one."""
    ov = F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))
    return F.coalesce(F.least(F.try_divide(ov, e1 - s1), F.try_divide(ov, e2 - s2)), F.lit(0.0))


def length_ratio_ok(a: Column, b: Column, most: float = 1.5) -> Column:
    """Whether the longer is at most ``most`` times the shorter; a zero length passes."""
    a, b = F.abs(a), F.abs(b)
    return (a == 0) | (b == 0) | (F.greatest(a, b) <= F.least(a, b) * most)


def match_reason(kind: Column, s1: Column, e1: Column, s2: Column, e2: Column, len1: Column, len2: Column, share: float = 0.5, ends: int = 500, ratio: float = 1.5) -> Column:
    """Why two records match: 'reciprocal_overlap', 'breakpoint' (both ends near), 'position' for
    insertions, or null."""
    near = (F.abs(s1 - s2) <= ends) & (F.abs(e1 - e2) <= ends) & length_ratio_ok(len1, len2, ratio)
    return (
        F.when((kind == "INS") & (F.abs(s1 - s2) <= ends) & length_ratio_ok(len1, len2, ratio), "position")
        .when((kind != "INS") & (reciprocal_overlap(s1, e1, s2, e2) >= share), "reciprocal_overlap")
        .when((kind != "INS") & near, "breakpoint")
    )


def length_ratio(a: Column, b: Column) -> Column:
    """The longer length over the shorter, which counts as 1 at least."""
    return F.greatest(a, b).cast("double") / F.greatest(F.least(a, b), F.lit(1))


def overlap_score(ro: Column, profile: Column, distance: Column, ratio: Column) -> Column:
    """Score of a pair of intervals: overlap and profile similarity, less the distance of both ends and
    the difference of lengths."""
    return ro * 1000 + F.coalesce(profile, F.lit(0.0)) * 50 - distance / 1000 - F.abs(ratio - 1) * 20


def sequence_score(jaccard: Column, containment: Column, profile: Column, distance: Column, ratio: Column) -> Column:
    """Score of a pair of insertions, from the similarity of their sequences."""
    return jaccard * 1000 + containment * 250 + F.coalesce(profile, F.lit(0.0)) * 50 - distance / 100 - F.abs(ratio - 1) * 30


@dataclass(frozen=True)
class MatchRule:
    """Limits of a candidate pair. Intervals are compared by both ends, insertions by sequence."""

    distance: int = 500
    least_overlap: float = 0.7
    most_ratio: float = 1.5
    least_profile: float = 0.5
    kinds: tuple[str, ...] = ("DEL", "DUP", "INV")
    sequence_kinds: tuple[str, ...] = ("INS",)
    k: int = 15
    least_jaccard: float = 0.35
    least_containment: float = 0.70


PUBLICATION = MatchRule()
#: Intervals only, with wider limits.
STRICT = MatchRule(distance=1000, least_overlap=0.5, most_ratio=2.0, least_profile=0.3, sequence_kinds=())


def scored_candidates(pairs: DataFrame, rule: MatchRule = PUBLICATION) -> DataFrame:
    """The pairs that the rule lets pass, with ``ro``, ``jaccard``, ``containment`` and ``score``.

    ``pairs`` has kind, a_s, a_e, b_s, b_e (half-open), a_len, b_len, a_seq, b_seq and profile, the
    similarity of the samples' profiles or null if there is none.
    """
    a_s, a_e, b_s, b_e = (F.col(c) for c in ("a_s", "a_e", "b_s", "b_e"))
    by_seq = F.col("kind").isin(list(rule.sequence_kinds)) if rule.sequence_kinds else F.lit(False)
    start_off, end_off = F.abs(a_s - b_s), F.abs(a_e - b_e)
    ratio = length_ratio(F.col("a_len"), F.col("b_len"))
    near = pairs.where((F.col("kind").isin(list(rule.kinds)) & (end_off <= rule.distance)) | by_seq).where((start_off <= rule.distance) & (ratio <= rule.most_ratio) & (F.col("profile").isNull() | (F.col("profile") >= rule.least_profile)))
    sim = F.when(by_seq, sequence_similarity(F.col("a_seq"), F.col("b_seq"), rule.k)) if rule.sequence_kinds else F.lit(None).cast("struct<jaccard:double,containment:double,orientation:string,k:int>")
    near = near.withColumn("__sim", sim).withColumn("ro", F.when(~by_seq, reciprocal_overlap(a_s, a_e, b_s, b_e)))
    fit = near.withColumns({"jaccard": F.col("__sim.jaccard"), "containment": F.col("__sim.containment"), "orientation": F.col("__sim.orientation")}).drop("__sim")
    fit = fit.where(F.when(by_seq, (F.col("jaccard") >= rule.least_jaccard) & (F.col("containment") >= rule.least_containment)).otherwise(F.col("ro") >= rule.least_overlap))
    score = F.when(by_seq, sequence_score(F.col("jaccard"), F.col("containment"), F.col("profile"), start_off, ratio)).otherwise(overlap_score(F.col("ro"), F.col("profile"), start_off + end_off, ratio))
    return fit.withColumn("score", F.round(score, 6))


def best_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of every group in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def reciprocal_best(cands: DataFrame, a: str, b: str, score: str, back: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, score) that are each other's best, where no other a has this b as its best and no
    other b this a.

    ``back`` holds the candidates seen from side b, if they differ. Ties are broken by the partner's
    id, so the result doesn't depend on row order.
    """
    best_a = best_per(cands, [a], [F.desc(score), b]).select(a, b, score)
    best_b = best_per(cands if back is None else back, [b], [F.desc(score), a]).select(F.col(a).alias("__a"), F.col(b).alias("__b"))
    once_b = best_a.groupBy(F.col(b).alias("__cb")).count().where("count = 1").select("__cb")
    once_a = best_b.groupBy(F.col("__a").alias("__ca")).count().where("count = 1").select("__ca")
    both = best_a.join(best_b, (F.col(a) == F.col("__a")) & (F.col(b) == F.col("__b"))).select(a, b, score)
    return both.join(once_b, F.col(b) == F.col("__cb"), "left_semi").join(once_a, F.col(a) == F.col("__ca"), "left_semi")


# --- fixed values: outcomes of a record and their reasons, for the first and the second side
ONLY = ("RefA_only_publication_lifted_no_match", "RefB_only_publication_lifted_no_match")
ONLY_REASON = ("unique_high_quality_synteny_liftover_but_no_matching_RefB_SV", "unique_high_quality_synteny_liftover_but_no_matching_RefA_SV")
MANY_TO_ONE = ("ambiguous_many_to_one", "multiple_RefA_records_choose_same_RefB_best")
ONE_TO_MANY = ("ambiguous_one_to_many", "multiple_RefB_records_choose_same_RefA_best")


def match_outcomes(records: DataFrame, cands: DataFrame, own: str, other: str, score: str, second: bool = False, back: DataFrame | None = None) -> DataFrame:
    """Every record of one side with ``partner``, ``status``, ``reason`` and ``confidence``.

    ``records`` has ``own``, kind and lift ('ok', or why the record has no place on the other side);
    ``cands`` comes from ``scored_candidates`` and ``back`` likewise, seen from the other side, if it
    differs. ``second`` says that ``own`` is the second side. A partner is shared only if it is a
    reciprocal best that is chosen once on either side. Insertions without one are unresolved; other
    records are ambiguous by how often their best, or they themselves, are chosen as a best; a record
    without candidates occurs on its side only.
    """
    side = int(second)
    best = best_per(cands, [own], [F.desc(score), other]).select(F.col(own).alias("__own"), F.col(other).alias("partner"), *("ro", "profile", "jaccard", "containment"))
    best_back = best_per(cands if back is None else back, [other], [F.desc(score), own]).select(F.col(other).alias("__p"), F.col(own).alias("__choice"))
    chosen = best.groupBy(F.col("partner").alias("__cp")).agg(F.count(F.lit(1)).alias("__n_partner"))
    own_chosen = best_back.groupBy(F.col("__choice").alias("__co")).agg(F.count(F.lit(1)).alias("__n_own"))
    out = records.join(best, F.col(own) == F.col("__own"), "left").join(best_back, F.col("partner") == F.col("__p"), "left")
    out = out.join(chosen, F.col("partner") == F.col("__cp"), "left").join(own_chosen, F.col(own) == F.col("__co"), "left")
    known = F.coalesce(F.col("kind").isin("DEL", "DUP", "INV", "INS"), F.lit(False))
    ins = F.col("kind") == "INS"
    shared = F.coalesce((F.col("__choice") == F.col(own)) & (F.col("__n_partner") == 1) & (F.col("__n_own") == 1), F.lit(False))
    lost = F.coalesce(F.col("lift"), F.lit("unknown"))
    by_partner, by_own = (ONE_TO_MANY, MANY_TO_ONE) if second else (MANY_TO_ONE, ONE_TO_MANY)

    def pick(i: int) -> Column:
        return (
            F.when(~known, ("unresolved_unsupported_svtype", "not_in_DEL_DUP_INV_INS")[i])
            .when(shared, F.when(ins, ("shared_strict_sequence", "reciprocal_best_liftover_ins_kmer")[i]).otherwise(("shared_strict_liftover", "reciprocal_best_synteny_liftover_ro")[i]))
            .when(ins, F.lit("ins_unresolved") if i == 0 else F.when(lost != "ok", lost).when(F.col("partner").isNotNull(), "INS_candidate_not_reciprocal_or_not_one_to_one").otherwise("INS_no_sequence_match_in_syntenic_target_window"))
            .when(lost != "ok", F.lit("ambiguous_synteny") if i == 0 else lost)
            .when(F.col("partner").isNull(), (ONLY[side], ONLY_REASON[side])[i])
            .when(F.col("__n_partner") > 1, by_partner[i])
            .when(F.col("__n_own") > 1, by_own[i])
            .otherwise(("ambiguous_not_reciprocal", "best_hit_not_reciprocal")[i])
        )

    strong = F.when(ins, (F.col("jaccard") >= 0.5) & (F.col("containment") >= 0.8)).otherwise((F.col("ro") >= 0.8) & (F.col("profile").isNull() | (F.col("profile") >= 0.7)))
    confidence = F.when(shared & strong, "high").when(shared | (pick(0) == ONLY[side]), "medium").otherwise("low")
    return out.select(*(F.col(c) for c in records.columns), "partner", pick(0).alias("status"), pick(1).alias("reason"), confidence.alias("confidence"))


def capped(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of every group: a limit on evidence that is part of the report."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def evidence_list(df: DataFrame, keys: list[str], item: str, order: list, n: int = 20, sep: str = ";") -> DataFrame:
    """Per group the first ``n`` items of the order as one string ``evidence``."""
    top = capped(df, keys, order, n)
    return top.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(item).cast("string").alias("i")))), lambda x: x["i"]), sep).alias("evidence"))


def fallback_join(left: DataFrame, right: DataFrame, candidates: list[Column], right_key: str, row_id: str) -> DataFrame:
    """Left join on the first of several candidate keys that exists on the right; adds ``key_rank``.

    ``right_key`` must be unique on the right.
    """
    tried = left.select(row_id, F.posexplode(F.array(*candidates)).alias("key_rank", "__key")).where("__key is not null")
    hit = tried.join(right.select(F.col(right_key).alias("__key")), "__key").groupBy(row_id).agg(F.min_by("__key", "key_rank").alias("__key"), F.min("key_rank").alias("key_rank"))
    return left.join(hit, row_id, "left").join(right, F.col("__key") == F.col(right_key), "left").drop("__key")


def resolve_parent(df: DataFrame, fid: str, parent: str, depth: int = 2) -> DataFrame:
    """Adds ``root``: the ancestor reached by following ``parent`` up to ``depth`` times; a parent that
    is no feature itself counts as the ancestor."""
    up = df.where(F.col(fid).isNotNull()).groupBy(fid).agg(F.max(parent).alias("__pp")).withColumnRenamed(fid, "__pid")
    out = df.withColumn("root", F.coalesce(parent, fid))
    for _ in range(depth - 1):
        out = out.join(up, F.col("root") == F.col("__pid"), "left").withColumn("root", F.coalesce("__pp", "root")).drop("__pid", "__pp")
    return out


def structure_match(new: DataFrame, old: DataFrame, gene: str, keys: list[str], start: str, end: str) -> DataFrame:
    """Genes of two annotations with an identical structure: (new_gene, old_gene); old_gene is null for
    a structure that is new. The signature is the ordered list of the gene's coordinates."""

    def sig(df: DataFrame, name: str) -> DataFrame:
        parts = df.groupBy(*keys, gene).agg(F.array_sort(F.collect_set(F.struct(start, end))).alias("s"))
        return parts.select(*keys, F.col(gene).alias(name), F.sha2(F.to_json("s"), 256).alias("sig"))

    o = sig(old, "old_gene").groupBy(*keys, "sig").agg(F.min("old_gene").alias("old_gene"))
    return sig(new, "new_gene").join(o, [*keys, "sig"], "left").select("new_gene", "old_gene")


def pair_mates(df: DataFrame, name: str, left_suffix: str, right_suffix: str) -> DataFrame:
    """Left and right halves whose ids agree without their suffix: all columns as l_* and r_*, and base."""
    half = lambda s, p: df.where(F.col(name).endswith(s)).select(F.expr(f"substring({name}, 1, length({name}) - {len(s)})").alias("base"), *(F.col(c).alias(f"{p}_{c}") for c in df.columns))
    return half(left_suffix, "l").join(half(right_suffix, "r"), "base")


def greedy_exclusive(blocks: DataFrame, block: str, size: str, members: str, share: float = 0.5, component: str | None = None, other: str | None = None, tie: str | None = None) -> DataFrame:
    """Keep blocks from the largest down while at least ``share`` of their members is unclaimed; a kept
    block claims all its members. Result: block ids.

    With ``other``, a second list of members on an axis of its own, that must hold on both sides. Equal
    sizes go by ``tie``, the least first, then by id. Blocks without members are not kept.

    The choice depends on its own history, so it runs once per ``component`` (a set of blocks that
    share members with no other; see the grouping of matches), or over all rows if none is given. Of
    blocks with the same members only the first can be kept: kept, it claims all of theirs, and
    dropped, it leaves them no more than it found. So a task gets one block per distinct set.
    """
    second = F.col(other) if other else F.array().cast(dict(blocks.dtypes)[members])
    rows = blocks.select(F.col(block).alias("b"), F.col(size).alias("n"), (F.col(tie).cast("double") if tie else F.lit(0.0)).alias("t"), F.col(members).alias("m"), second.alias("o"), F.col(component).alias("c") if component else F.lit(0).alias("c"))

    first = F.min(F.struct(F.col("n").isNull().alias("x"), (-F.col("n")).alias("y"), F.coalesce("t", F.lit(float("inf"))).alias("t"), F.col("b")))
    rows = rows.groupBy("c", F.array_sort("m").alias("m"), F.array_sort("o").alias("o")).agg(first.alias("f")).select(F.col("f.b").alias("b"), (-F.col("f.y")).alias("n"), F.col("f.t").alias("t"), "m", "o", "c")
    two = other is not None

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        claimed: tuple[set, set] = set(), set()
        kept = []
        for row in pdf.sort_values(["n", "t", "b"], ascending=[False, True, True]).itertuples():
            sides = (row.m, row.o) if two else (row.m,)
            if all(len(x) and sum(v not in done for v in x) >= share * len(x) for x, done in zip(sides, claimed)):
                kept.append(row.b)
                for x, done in zip(sides, claimed):
                    done.update(x)
        return pd.DataFrame({block: kept})

    return rows.groupBy("c").applyInPandas(pick, f"{block} {dict(rows.dtypes)['b']}")


def kmers(seq: Column, k: Column | int) -> Column:
    """Overlapping substrings of length k; an empty array for a shorter sequence.

    One pass of a pattern that looks k characters ahead and moves on by one: substrings by position
    would cost the square of the length, as positions in a string are counted from its start.
    """
    k = F.lit(k) if isinstance(k, int) else k
    return F.regexp_extract_all(seq, F.concat(F.lit("(?s)(?=(.{"), k.cast("string"), F.lit("})).")), F.lit(1))


def kmer_similarity(a: Column, b: Column, k: int = 15) -> tuple[Column, Column]:
    """(Jaccard, containment in the smaller set) of k-mer sets of any two texts, k adapted to short ones."""
    size = F.greatest(F.lit(5), F.least(F.lit(k), F.floor(F.least(F.length(a), F.length(b)) / 3).cast("int")))
    x, y = F.array_distinct(kmers(a, size)), F.array_distinct(kmers(b, size))
    shared = F.size(F.array_intersect(x, y))
    return F.try_divide(shared, F.size(F.array_union(x, y))), F.try_divide(shared, F.least(F.size(x), F.size(y)))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def sequence_similarity(a: Column, b: Column, k: int = 15) -> Column:
    """struct(jaccard, containment, orientation, k) of two nucleotide sequences, over both strands of b.

    k is adapted to the shorter sequence; a sequence shorter than k is its own only k-mer. Of the two
    strands the one with the larger (jaccard, containment) counts, the forward one if they are equal.
    Null if a sequence is null or empty. Case doesn't matter.
    """
    x, y = (F.translate(c, _LETTERS, _LETTERS.upper()) for c in (a, b))
    size = F.greatest(F.lit(5), F.least(F.lit(k), F.greatest(F.lit(5), F.floor(F.least(F.length(x), F.length(y)) / 3).cast("int"))))

    def words(seq: Column) -> Column:
        return F.when(F.length(seq) < size, F.array(seq)).otherwise(F.array_distinct(kmers(seq, size)))

    def score(other: Column, orientation: str) -> Column:
        def of(p: Column, q: Column) -> Column:
            shared = F.size(F.array_intersect(p, q))
            return F.struct((shared / (F.size(p) + F.size(q) - shared)).alias("jaccard"), (shared / F.least(F.size(p), F.size(q))).alias("containment"), F.lit(orientation).alias("orientation"), size.alias("k"))

        return F.get(F.transform(F.array(F.struct(words(x).alias("p"), words(other).alias("q"))), lambda z: of(z["p"], z["q"])), F.lit(0))

    same, turned = score(y, "same"), score(F.reverse(F.translate(y, "ACGTN", "TGCAN")), "reverse_complement")
    both = F.transform(F.array(F.struct(same.alias("s"), turned.alias("t"))), lambda z: F.when((z["t"]["jaccard"] > z["s"]["jaccard"]) | ((z["t"]["jaccard"] == z["s"]["jaccard"]) & (z["t"]["containment"] > z["s"]["containment"])), z["t"]).otherwise(z["s"]))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.get(both, F.lit(0)))


def apply_groups(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """A function of the caller per group, for semantics no expression covers; groups must be bounded."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf)

    return df.groupBy(*keys).applyInPandas(run, schema)


def apply_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """A table function of the caller: yields any number of rows per batch."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield from fn(part)

    return df.mapInPandas(run, schema)
