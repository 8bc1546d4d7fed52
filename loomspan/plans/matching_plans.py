"""Matching, presence/absence and accumulation queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import intervals as I
from loomspan.operators import karyotype as K
from loomspan.operators import matching as M
from loomspan.operators import pav as P
from loomspan.operators import relational as R
from loomspan.operators.islands import island_ids
from loomspan.plans.signal_plans import CALLS, _calls
from loomspan.runtime import Stored, table

A, B = "lrc%", "asm%"


def _two_sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = _calls(spark, d).where("type is not null")
    left = c.where(F.col("id").like(A)).select(F.col("id").alias("a"), F.col("chrom").alias("a_chrom"), F.col("type").alias("a_type"), F.col("c_start").alias("a_s"), F.col("c_end").alias("a_e"))
    right = c.where(F.col("id").like(B)).select(F.col("id").alias("b"), F.col("chrom").alias("b_chrom"), F.col("type").alias("b_type"), F.col("c_start").alias("b_s"), F.col("c_end").alias("b_e"))
    return left, right


def _cands(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of equal type within 500 bp, with the reason and a score."""
    left, right = _two_sets(spark, d)
    j = I.overlap_join(left, right, [("a_chrom", "b_chrom"), ("a_type", "b_type")], I.Span("a_s", "a_e"), I.Span("b_s", "b_e"), slack=500)
    a_s, a_e, b_s, b_e = (F.col(c) for c in ("a_s", "a_e", "b_s", "b_e"))
    j = j.withColumn("reason", M.match_reason(F.col("a_type"), a_s, a_e, b_s, b_e, a_e - a_s, b_e - b_s)).where("reason is not null")
    ro = M.reciprocal_overlap(a_s, a_e, b_s, b_e)
    score = M.overlap_score(ro, F.lit(None).cast("double"), F.abs(a_s - b_s) + F.abs(a_e - b_e), M.length_ratio(a_e - a_s, b_e - b_s))
    return j.withColumn("score", F.round(score, 6)).select("a", "b", "reason", "score")


def match_candidates(spark, d):
    return _cands(spark, d)


def _records(spark: SparkSession, d: str, like: str, p: str) -> DataFrame:
    """Calls of one caller with a length, a stand-in for their sequence and one for their samples' profile.

    The tables hold neither: the sequence is made of digests of the place (in steps of 400 bp) and of
    the id, the profile of 12 bits of the id's digest. A chromosome without a chunk has no lift.
    """
    c = table(spark, d, "sv_calls").where(F.col("pos").isNotNull() & F.col("end").isNotNull() & F.col("chrom").isNotNull() & F.col("id").like(like))
    c = c.groupBy("id", "chrom", "type", F.least("pos", "end").alias("s"), F.greatest("pos", "end").alias("e")).agg(F.max("len").alias("len"))
    lifted = table(spark, d, "chunks").where("chrom is not null").select(F.col("chrom").alias("l_chrom")).distinct()
    bases = lambda x: F.translate(F.md5(x.cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")
    return c.join(lifted, F.col("chrom") == F.col("l_chrom"), "left").select(
        F.col("id").alias(p), F.col("chrom").alias(f"{p}_chrom"), F.col("type").alias(f"{p}_type"), (F.col("s") - 1).alias(f"{p}_s"), F.col("e").alias(f"{p}_e"), F.coalesce("len", F.col("e") - F.col("s") + 1).alias(f"{p}_len"),
        F.concat(bases(F.concat_ws(":", "chrom", F.floor(F.col("s") / 400).cast("string"))), F.substring(bases(F.col("id")), 1, 8)).alias(f"{p}_seq"), F.conv(F.substring(F.md5(F.col("id").cast("binary")), 1, 3), 16, 10).cast("bigint").alias(f"{p}_mask"),
        F.when(F.col("l_chrom").isNotNull(), "ok").otherwise("no_block").alias(f"{p}_lift"),
    )


def _scored(spark: SparkSession, d: str, rule: M.MatchRule) -> DataFrame:
    left, right = _records(spark, d, A, "a").where("a_lift = 'ok'"), _records(spark, d, B, "b")
    j = I.overlap_join(left, right, [("a_chrom", "b_chrom"), ("a_type", "b_type")], I.Span("a_s", "a_e"), I.Span("b_s", "b_e"), slack=rule.distance)
    x, y = F.col("a_mask"), F.col("b_mask")
    profile = F.when((F.bit_count(x) >= 2) & (F.bit_count(y) >= 2), P.mask_jaccard(x, y))
    return M.scored_candidates(j.withColumn("profile", profile).withColumn("kind", F.col("a_type")), rule)


_EVIDENCE = ("ro", "profile", "jaccard", "containment", "orientation")


def scored_candidates(spark, d):
    """Candidates with their evidence: intervals by overlap and ends, insertions by sequence."""
    return _scored(spark, d, M.PUBLICATION).select("a", "b", "kind", *(F.round(c, 9).alias(c) for c in _EVIDENCE[:-1]), "orientation", "score")


def _kept(spark: SparkSession, d: str, rule: M.MatchRule) -> DataFrame:
    """The candidates, computed once for the several steps that read them."""
    return Stored(_scored(spark, d, rule).select("a", "b", "score", *_EVIDENCE), "candidates").df


def reciprocal_best(spark, d):
    return M.reciprocal_best(_kept(spark, d, M.PUBLICATION), "a", "b", "score")


def strict_candidates(spark, d):
    return _scored(spark, d, M.STRICT).select("a", "b", "kind", F.round("ro", 9).alias("ro"), F.round("profile", 9).alias("profile"), "score")


def strict_best(spark, d):
    return M.reciprocal_best(_kept(spark, d, M.STRICT), "a", "b", "score")


def match_outcomes(spark, d):
    """Every call of both callers with its partner, outcome, reason and confidence."""
    kept = _kept(spark, d, M.PUBLICATION)
    sides = [M.match_outcomes(_records(spark, d, like, own).select(F.col(own), F.col(f"{own}_type").alias("kind"), F.col(f"{own}_lift").alias("lift")), kept, own, other, "score", own == "b").withColumnRenamed(own, "id").withColumn("side", F.lit(own)) for like, own, other in ((A, "a", "b"), (B, "b", "a"))]
    return sides[0].unionByName(sides[1]).select("side", "id", "kind", "partner", "status", "reason", "confidence")


def unmatched_reasons(spark, d):
    """How many calls of either side have which outcome."""
    return match_outcomes(spark, d).groupBy("side", "status", "reason", "confidence").agg(F.count(F.lit(1)).alias("n"))


def sequence_similarity(spark, d):
    """Every sequence named in the texts against the next of its source, and a stretch of its other strand."""
    s = table(spark, d, "documents").where("source is not null and text is not null").select("doc_id", "source", F.posexplode(F.regexp_extract_all("text", F.lit("([ACGTN]{60,})"), F.lit(1))).alias("pos", "seq"))
    from pyspark.sql import Window

    nxt = s.withColumn("next", F.lead("seq").over(Window.partitionBy("source").orderBy("doc_id", "pos")))
    turned = F.lower(F.reverse(F.translate(F.substring("seq", 11, 40), "ACGTN", "TGCAN")))
    both = nxt.select("doc_id", "pos", "seq", F.inline(F.array(F.struct(F.lit("next").alias("against"), F.col("next").alias("other")), F.struct(F.lit("stretch").alias("against"), turned.alias("other")), F.struct(F.lit("short").alias("against"), F.substring("seq", 1, 3).alias("other")))))
    sim = both.select("doc_id", "pos", "against", M.sequence_similarity(F.col("seq"), F.col("other"), 15).alias("m")).where("m is not null")
    return sim.select("doc_id", "pos", "against", F.round("m.jaccard", 9).alias("jaccard"), F.round("m.containment", 9).alias("containment"), "m.orientation", "m.k")


def capped_evidence(spark, d):
    """At most three partners per call by score, joined to one string."""
    return M.evidence_list(_cands(spark, d), ["a"], "b", [F.desc("score"), "b"], 3)


def fallback_key(spark, d):
    """Documents joined to the mixture's targets by source, else by the part before '_'."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    t = table(spark, d, "mix_targets").select(F.col("source").alias("t_source"), "target_share")
    cand = [F.col("source"), F.concat(F.split("source", "_")[0], F.lit("_log")), F.lit("mail")]
    return M.fallback_join(docs, t, cand, "t_source", "doc_id").select("doc_id", "t_source", "key_rank", "target_share")


def parent_resolution(spark, d):
    g = table(spark, d, "gtf").where("transcript_id is not null and gene_id is not null").select(F.col("transcript_id").alias("fid"), F.col("gene_id").alias("parent")).distinct()
    e = table(spark, d, "gtf").where("type = 'exon' and transcript_id is not null").select(F.concat(F.lit("e:"), "transcript_id").alias("fid"), F.col("transcript_id").alias("parent")).distinct()
    out = M.resolve_parent(e.unionByName(g), "fid", "parent", 2)
    return out.where(F.col("fid").startswith("e:")).groupBy("root").agg(F.count(F.lit(1)).alias("n"))


def structure_match(spark, d):
    """Genes of two sources with the same exon structure, whatever their ids."""
    g = table(spark, d, "gtf").where("type = 'exon' and gene_id is not null and seq_id is not null and strand is not null and left is not null and right is not null")
    s = M.structure_match(g.where("source in ('liftset', 'weaver')"), g.where("source not in ('liftset', 'weaver')"), "gene_id", ["seq_id", "strand"], "left", "right")
    return s.select("new_gene", "old_gene")


def mate_pairs(spark, d):
    """Calls of two callers whose ids agree without the caller's prefix."""
    c = _calls(spark, d).select("id").distinct().withColumn("rev", F.concat(F.substring("id", 4, 20), F.substring("id", 1, 3)))
    return M.pair_mates(c, "rev", "lrc", "asm").select("base", F.col("l_id").alias("l"), F.col("r_id").alias("r"))


def kmer_similarity(spark, d):
    """Every text and the next one of its source, compared by their sets of 5-mers."""
    docs = table(spark, d, "documents").where("text is not null and source is not null").select("doc_id", "source", F.col("text").alias("t"))
    from pyspark.sql import Window

    nxt = docs.withColumn("u", F.lead("t").over(Window.partitionBy("source").orderBy("doc_id"))).where("u is not null")
    j, c = M.kmer_similarity(F.col("t"), F.col("u"), 5)
    return nxt.select("doc_id", F.round(j, 9).alias("jaccard"), F.round(c, 9).alias("containment"))


def greedy_exclusive(spark, d):
    """Calls as blocks of the 50 kb bins they cover; a component is a chain of calls that share bins.

    Of calls over the same bins only the longest can be kept, so the chains are built of those: their
    number is bounded by the axis, however many calls there are.
    """
    c = _calls(spark, d).withColumns({"b0": F.floor(F.col("c_start") / 50_000), "b1": F.floor((F.col("c_end") - 1) / 50_000) + 1})
    c = c.groupBy("chrom", "b0", "b1").agg(F.min_by(F.struct("id", "c_start", "c_end"), F.struct(F.col("c_start") - F.col("c_end"), "id")).alias("x")).select("chrom", "b0", "b1", "x.*")
    c = island_ids(c, ["chrom"], "b0", "b1", gap=-1, ties=["id"])
    b = c.select("id", F.concat_ws(":", "chrom", F.col("island").cast("string")).alias("component"), (F.col("c_end") - F.col("c_start")).alias("n"), F.sequence("b0", F.col("b1") - 1).alias("bins"))
    return M.greedy_exclusive(b, "id", "n", "bins", 0.5, "component")


def greedy_two_sided(spark, d):
    """Calls as blocks of 50 kb bins on two axes, the second one shifted by 25 kb, by quality where equal
    in size; a component is a chain of calls that share bins on either axis."""
    c = _calls(spark, d).withColumns({"b0": F.floor(F.col("c_start") / 50_000), "b1": F.floor((F.col("c_end") - 1) / 50_000) + 1, "o0": F.floor((F.col("c_start") + 25_000) / 50_000), "o1": F.floor((F.col("c_end") + 24_999) / 50_000) + 1})
    order = F.struct(F.col("c_start") - F.col("c_end"), F.coalesce(-F.col("qual"), F.lit(float("inf"))), F.col("id"))
    c = c.groupBy("chrom", "b0", "b1", "o0", "o1").agg(F.min_by(F.struct("id", "c_start", "c_end", "qual"), order).alias("x")).select("chrom", "b0", "b1", "o0", "o1", "x.*")
    c = island_ids(c, ["chrom"], "b0", "o1", gap=-1, ties=["id"])
    b = c.select("id", F.concat_ws(":", "chrom", F.col("island").cast("string")).alias("component"), (F.col("c_end") - F.col("c_start")).alias("n"), (-F.col("qual")).alias("tie"), F.sequence("b0", F.col("b1") - 1).alias("m"), F.sequence("o0", F.col("o1") - 1).alias("o"))
    return M.greedy_exclusive(b, "id", "n", "m", 0.5, "component", "o", "tie")


def pair_combinations(spark, d):
    """Unordered pairs of nations of one region whose names share the first letter or more."""
    n = table(spark, d, "nation")
    j = R.unordered_pairs(n, ["n_regionkey"], "n_nationkey", lambda x, y: F.length(x("n_name")) >= F.length(y("n_name")))
    return j.select(F.col("l.n_nationkey").alias("a"), F.col("r.n_nationkey").alias("b"))


# --- presence/absence: part types by nation of the buyer


def _present(spark: SparkSession, d: str) -> DataFrame:
    """(item, nation): the part was bought by the nation at least once."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("l_partkey").alias("item"), F.col("c_nationkey").alias("nation")).distinct()


PRES = "WITH pres AS (SELECT DISTINCT l_partkey AS item, c_nationkey AS nation FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey), freq AS (SELECT item, count(*) AS n_samples FROM pres GROUP BY item)"


def shared_specific(spark, d):
    return P.shared_specific(_present(spark, d), "item", "nation").select("nation", "shared", "specific", F.round("shared_pct", 9).alias("shared_pct"), F.round("specific_pct", 9).alias("specific_pct"))


def presence_spectrum(spark, d):
    return P.spectrum(P.frequencies(_present(spark, d), "item", "nation"), 25)


def family_categories(spark, d):
    return P.category_summary(P.frequencies(_present(spark, d), "item", "nation"), 25, 8).withColumn("pct", F.round("pct", 9))


def category_matrix(spark, d):
    """Items by nation and category of the item."""
    p = _present(spark, d)
    f = P.frequencies(p, "item", "nation").withColumn("cat", P.category(F.col("n_samples"), 25, 8))
    return p.join(f, "item").groupBy("nation").pivot("cat", ["Core", "Softcore", "Dispensable", "Private"]).agg(F.count(F.lit(1))).na.fill(0).select("nation", F.col("Core").alias("core"), F.col("Softcore").alias("softcore"), F.col("Dispensable").alias("dispensable"), F.col("Private").alias("private"))


def pan_core_exact(spark, d):
    out = P.pan_core_exact(P.frequencies(_present(spark, d), "item", "nation"), 25)
    return out.select("k", F.round("pan", 6).alias("pan"), F.round("core", 6).alias("core"))


def _masks(spark, d) -> DataFrame:
    reg = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    p = _present(spark, d).join(reg, F.col("nation") == F.col("n_nationkey")).select("item", F.col("n_regionkey").alias("o"))
    return P.masks(p, "item", "o")


def pan_core_exhaustive(spark, d):
    """All 31 subsets of five regions, by the zeta transform."""
    return P.pan_core_exhaustive(_masks(spark, d), 5)


def pan_core_subsets(spark, d):
    """The same subsets counted one by one: an independent check."""
    return P.pan_core_subsets(_masks(spark, d), 5, list(range(1, 32)))


def pan_core_summary(spark, d):
    return P.curve_summary(P.pan_core_exhaustive(_masks(spark, d), 5))


def pan_core_sampled(spark, d):
    """Random subsets of 25 nations (seeded)."""
    p = P.masks(_present(spark, d), "item", "nation")
    return P.curve_summary(P.pan_core_subsets(p, 25, P.random_subsets(25, 5, 1)))


def mask_jaccard(spark, d):
    """Profile similarity of every part and the next one."""
    from pyspark.sql import Window

    m = _masks(spark, d).withColumn("brand_order", F.col("item") % 25)
    nxt = m.withColumn("other", F.lead("mask").over(Window.partitionBy("brand_order").orderBy("item"))).where("other is not null")
    return nxt.select("item", F.round(P.mask_jaccard(F.col("mask"), F.col("other")), 9).alias("jaccard"))


def _states(spark, d) -> DataFrame:
    """Tri-state genotype per (variant, sample)."""
    c = table(spark, d, "sv_calls").where("sample is not null").groupBy("id", "sample").agg(F.min("gt").alias("gt"))
    return c.select("id", "sample", P.genotype_state(F.col("gt")).alias("state"), P.genotype_strict(F.col("gt")).alias("strict"), "gt")


def genotype_states(spark, d):
    return _states(spark, d).groupBy("sample").agg(F.count_if(F.col("state") == 1).alias("present"), F.count_if(F.col("state") == 0).alias("absent"), F.count_if(F.col("state").isNull()).alias("missing"), F.count_if("strict").alias("strict"))


def sample_state_stats(spark, d):
    out = P.sample_stats(_states(spark, d), "id", "sample", "state")
    return out.withColumn("missing_rate", F.round("missing_rate", 9))


def combined_states(spark, d):
    """Tri-state OR of two order statuses per customer."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 0).alias("s"))
    g = o.groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderpriority") < "3", F.col("s"))).alias("x"), F.max(F.when(F.col("o_orderpriority") >= "3", F.col("s"))).alias("y"))
    return g.select("o_custkey", P.combine_states(F.col("x"), F.col("y")).alias("state"))


def presence_rules(spark, d):
    """Five presence rules on the same cells."""
    v = F.when(F.col("event_id") % 11 == 0, "").when(F.col("event_id") % 11 == 1, ".").when(F.col("event_id") % 11 == 2, "NA").when(F.col("event_id") % 11 == 3, "0").when(F.col("event_id") % 11 == 4, "0.0").when(F.col("event_id") % 11 == 5, "1").when(F.col("event_id") % 11 == 6, "2").when(F.col("event_id") % 11 == 7, "TRUE").when(F.col("event_id") % 11 == 8, "0/0").when(F.col("event_id") % 11 == 9, "./.").otherwise("0/1")
    e = table(spark, d, "events").select("event_type", v.alias("v"))
    return e.groupBy("event_type", "v").agg(F.count_if(P.presence_numeric(F.col("v"))).alias("numeric"), F.count_if(P.presence_token(F.col("v"))).alias("token"), F.count_if(P.presence_truthy(F.col("v"))).alias("truthy"), F.count_if(P.genotype_strict(F.col("v"))).alias("strict"))


def orthology_classes(spark, d):
    """Copies of a part by the five regions, region 0 as target."""
    reg = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    n = _present(spark, d).join(reg, F.col("nation") == F.col("n_nationkey")).groupBy("item").pivot("n_regionkey", [0, 1, 2, 3, 4]).agg(F.count(F.lit(1))).na.fill(0)
    cls = P.orthology_class(F.array(*(F.col(str(i)) for i in range(5))), F.col("0"))
    return n.select(cls.alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


def low_copy_families(spark, d):
    reg = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    n = _present(spark, d).join(reg, F.col("nation") == F.col("n_nationkey")).groupBy("item", "n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    return P.low_copy(n, "item", "n_regionkey", "n", 5, 3)


def block_orientation(spark, d):
    """Orientation of the order of prices against line numbers in an order."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("z"))
    b = li.where(F.size("z") >= 4).select("l_orderkey", F.col("z.l_linenumber").alias("x"), F.col("z.l_partkey").alias("y"))
    return K.block_orientation(b, "l_orderkey", "x", "y").groupBy("orientation").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        match_candidates, scored_candidates, reciprocal_best, strict_candidates, strict_best, match_outcomes, unmatched_reasons, sequence_similarity, capped_evidence, fallback_key, parent_resolution, structure_match, mate_pairs, kmer_similarity, greedy_exclusive, greedy_two_sided, pair_combinations, shared_specific, presence_spectrum, family_categories, category_matrix, pan_core_exact,
        pan_core_exhaustive, pan_core_subsets, pan_core_summary, pan_core_sampled, mask_jaccard, genotype_states, sample_state_stats, combined_states, presence_rules, orthology_classes, low_copy_families, block_orientation,
    )
}

_CAND = f"""WITH {CALLS}, l AS (SELECT id AS a, chrom, type, c_start AS a_s, c_end AS a_e FROM calls WHERE id LIKE 'lrc%' AND type IS NOT NULL), r AS (SELECT id AS b, chrom, type, c_start AS b_s, c_end AS b_e FROM calls WHERE id LIKE 'asm%' AND type IS NOT NULL),
j AS (SELECT a, b, l.type, a_s, a_e, b_s, b_e, greatest(least(a_e, b_e) - greatest(a_s, b_s), 0) AS ov, greatest(a_e - a_s, b_e - b_s) <= 1.5 * least(a_e - a_s, b_e - b_s) AS fit FROM l JOIN r ON l.chrom = r.chrom AND l.type = r.type AND a_s - 500 < b_e AND b_s < a_e + 500),
k AS (SELECT *, least(ov / (a_e - a_s), ov / (b_e - b_s)) AS ro FROM j),
c AS (SELECT a, b, CASE WHEN type = 'INS' THEN CASE WHEN abs(a_s - b_s) <= 500 AND fit THEN 'position' END WHEN ro >= 0.5 THEN 'reciprocal_overlap' WHEN abs(a_s - b_s) <= 500 AND abs(a_e - b_e) <= 500 AND fit THEN 'breakpoint' END AS reason, round(ro * 1000 - (abs(a_s - b_s) + abs(a_e - b_e)) / 1000 - abs(greatest(a_e - a_s, b_e - b_s) / greatest(least(a_e - a_s, b_e - b_s), 1) - 1) * 20, 6) AS score FROM k),
cand AS (SELECT * FROM c WHERE reason IS NOT NULL)"""


def _rec(p: str, like: str) -> str:
    return f"""{p}0 AS (SELECT id, chrom, type, least(pos, "end") AS s, greatest(pos, "end") AS e, max(len) AS len FROM sv_calls WHERE pos IS NOT NULL AND "end" IS NOT NULL AND chrom IS NOT NULL AND id LIKE '{like}' GROUP BY ALL),
{p}r AS (SELECT id AS {p}, chrom, type, s AS {p}_pos, e AS {p}_end, coalesce(len, e - s + 1) AS {p}_len, translate(md5(chrom || ':' || (s // 400)), '0123456789abcdef', 'ACGTACGTACGTACGT') || substring(translate(md5(id), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 8) AS {p}_seq,
  CAST('0x' || substring(md5(id), 1, 3) AS INTEGER) AS {p}_mask, CASE WHEN chrom IN (SELECT chrom FROM chunks WHERE chrom IS NOT NULL) THEN 'ok' ELSE 'no_block' END AS {p}_lift FROM {p}0)"""


# k-mers of 13 letters: the sequences have 40
_KM = "list_distinct(list_transform(range(1, 29), lambda i: substring({}, i, 13)))"


def _scored_sql(distance: int, overlap: float, ratio: float, profile: float, ins: bool) -> str:
    """Candidates and best choices, by the rules as they are stated: closed ends, both directions alike."""
    return f"""WITH {_rec("a", A)}, {_rec("b", B)},
p0 AS (SELECT a, b, ar.type AS kind, a_pos, a_end, b_pos, b_end, a_len, b_len, a_seq, b_seq, CASE WHEN bit_count(a_mask) >= 2 AND bit_count(b_mask) >= 2 THEN bit_count(a_mask & b_mask) / bit_count(a_mask | b_mask) END AS profile, greatest(a_len, b_len) / greatest(1, least(a_len, b_len)) AS lr
  FROM ar JOIN br ON ar.chrom = br.chrom AND ar.type = br.type AND a_lift = 'ok' AND abs(a_pos - b_pos) <= {distance} WHERE ar.type IN ('DEL', 'DUP', 'INV'{", 'INS'" if ins else ""})),
p1 AS (SELECT *, CASE WHEN kind <> 'INS' THEN least(greatest(0, least(a_end, b_end) - greatest(a_pos, b_pos) + 1) / (a_end - a_pos + 1), greatest(0, least(a_end, b_end) - greatest(a_pos, b_pos) + 1) / (b_end - b_pos + 1)) END AS ro,
  CASE WHEN kind = 'INS' THEN {_KM.format("a_seq")} END AS ka, CASE WHEN kind = 'INS' THEN {_KM.format("b_seq")} END AS kb, CASE WHEN kind = 'INS' THEN {_KM.format("reverse(translate(b_seq, 'ACGT', 'TGCA'))")} END AS kr FROM p0 WHERE lr <= {ratio} AND (profile IS NULL OR profile >= {profile}) AND (kind = 'INS' OR abs(a_end - b_end) <= {distance})),
p2 AS (SELECT *, len(list_intersect(ka, kb)) AS i1, len(list_intersect(ka, kr)) AS i2 FROM p1),
p3 AS (SELECT *, i1 / (len(ka) + len(kb) - i1) AS j1, i1 / least(len(ka), len(kb)) AS c1, i2 / (len(ka) + len(kr) - i2) AS j2, i2 / least(len(ka), len(kr)) AS c2 FROM p2),
p4 AS (SELECT *, CASE WHEN (j2, c2) > (j1, c1) THEN j2 ELSE j1 END AS jaccard, CASE WHEN (j2, c2) > (j1, c1) THEN c2 ELSE c1 END AS containment, CASE WHEN kind = 'INS' THEN CASE WHEN (j2, c2) > (j1, c1) THEN 'reverse_complement' ELSE 'same' END END AS orientation FROM p3),
cand AS (SELECT *, round(CASE WHEN kind = 'INS' THEN jaccard * 1000 + containment * 250 + coalesce(profile, 0) * 50 - abs(a_pos - b_pos) / 100 - abs(lr - 1) * 30
  ELSE ro * 1000 + coalesce(profile, 0) * 50 - (abs(a_pos - b_pos) + abs(a_end - b_end)) / 1000 - abs(lr - 1) * 20 END, 6) AS score FROM p4 WHERE CASE WHEN kind = 'INS' THEN jaccard >= 0.35 AND containment >= 0.70 ELSE ro >= {overlap} END),
ba AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) = 1), bb AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY b ORDER BY score DESC, a) = 1),
nb AS (SELECT b AS id, count(*) AS n FROM ba GROUP BY b), na AS (SELECT a AS id, count(*) AS n FROM bb GROUP BY a),
best AS (SELECT ba.a, ba.b, ba.score FROM ba JOIN bb ON ba.a = bb.a AND ba.b = bb.b JOIN nb ON nb.id = ba.b AND nb.n = 1 JOIN na ON na.id = ba.a AND na.n = 1)"""


_PUB, _STRICT = _scored_sql(500, 0.7, 1.5, 0.5, True), _scored_sql(1000, 0.5, 2.0, 0.3, False)


def _side_sql(own: str, other: str) -> str:
    first = own == "a"
    many, one = ("many_to_one", "one_to_many"), ("one_to_many", "many_to_one")
    by_partner, by_own = many if first else one
    text = {"many_to_one": "multiple_RefA_records_choose_same_RefB_best", "one_to_many": "multiple_RefB_records_choose_same_RefA_best"}
    mine, theirs = ("RefA", "RefB") if first else ("RefB", "RefA")
    return f"""SELECT '{own}' AS side, r.{own} AS id, r.type AS kind, x.{other} AS partner,
  CASE WHEN r.type IS NULL OR r.type NOT IN ('DEL', 'DUP', 'INV', 'INS') THEN 'unresolved_unsupported_svtype' WHEN m.{own} IS NOT NULL THEN CASE WHEN r.type = 'INS' THEN 'shared_strict_sequence' ELSE 'shared_strict_liftover' END WHEN r.type = 'INS' THEN 'ins_unresolved'
    WHEN r.{own}_lift <> 'ok' THEN 'ambiguous_synteny' WHEN x.{own} IS NULL THEN '{mine}_only_publication_lifted_no_match' WHEN np.n > 1 THEN 'ambiguous_{by_partner}' WHEN no.n > 1 THEN 'ambiguous_{by_own}' ELSE 'ambiguous_not_reciprocal' END AS status,
  CASE WHEN r.type IS NULL OR r.type NOT IN ('DEL', 'DUP', 'INV', 'INS') THEN 'not_in_DEL_DUP_INV_INS' WHEN m.{own} IS NOT NULL THEN CASE WHEN r.type = 'INS' THEN 'reciprocal_best_liftover_ins_kmer' ELSE 'reciprocal_best_synteny_liftover_ro' END
    WHEN r.{own}_lift <> 'ok' THEN r.{own}_lift WHEN r.type = 'INS' THEN CASE WHEN x.{own} IS NOT NULL THEN 'INS_candidate_not_reciprocal_or_not_one_to_one' ELSE 'INS_no_sequence_match_in_syntenic_target_window' END
    WHEN x.{own} IS NULL THEN 'unique_high_quality_synteny_liftover_but_no_matching_{theirs}_SV' WHEN np.n > 1 THEN '{text[by_partner]}' WHEN no.n > 1 THEN '{text[by_own]}' ELSE 'best_hit_not_reciprocal' END AS reason,
  CASE WHEN m.{own} IS NOT NULL THEN CASE WHEN r.type = 'INS' AND x.jaccard >= 0.5 AND x.containment >= 0.8 OR r.type <> 'INS' AND x.ro >= 0.8 AND coalesce(x.profile, 1) >= 0.7 THEN 'high' ELSE 'medium' END
    WHEN r.type IN ('DEL', 'DUP', 'INV') AND r.{own}_lift = 'ok' AND x.{own} IS NULL THEN 'medium' ELSE 'low' END AS confidence
FROM {own}r r LEFT JOIN b{own} x ON x.{own} = r.{own} LEFT JOIN best m ON m.{own} = r.{own} LEFT JOIN n{other} np ON np.id = x.{other} LEFT JOIN n{own} no ON no.id = r.{own}"""


_OUTCOMES = f"{_PUB}, o AS ({_side_sql('a', 'b')} UNION ALL {_side_sql('b', 'a')})"
_BIT = "mk AS (SELECT item, bit_or(1 << n_regionkey) AS mask FROM pres JOIN nation ON nation = n_nationkey GROUP BY item), cnt AS (SELECT mask, count(*) AS items FROM mk GROUP BY mask), sub AS (SELECT unnest(range(1, 32)) AS subset), cur AS (SELECT CAST(subset AS BIGINT) AS subset, CAST(bit_count(subset) AS INTEGER) AS k, CAST(coalesce(sum(items) FILTER ((mask & subset) <> 0), 0) AS BIGINT) AS pan, CAST(coalesce(sum(items) FILTER ((mask & subset) = subset), 0) AS BIGINT) AS core FROM sub, cnt GROUP BY subset)"


def _pan_rows() -> str:
    n = 25
    rows = ", ".join(f"({k}, {s}, {1.0 - (math.comb(n - s, k) if n - s >= k else 0) / math.comb(n, k)!r}, {(math.comb(s, k) if s >= k else 0) / math.comb(n, k)!r})" for k in range(1, n + 1) for s in range(1, n + 1))
    return f"w(k, n_samples, pw, cw) AS (VALUES {rows})"


_GT = """WITH g AS (SELECT id, sample, min(gt) AS gt FROM sv_calls WHERE sample IS NOT NULL GROUP BY id, sample),
st AS (SELECT *, list_filter(string_split(replace(gt, '|', '/'), '/'), lambda x: x <> '.' AND x <> '') AS al FROM g),
s AS (SELECT id, sample, gt, CASE WHEN gt IS NULL OR len(al) = 0 THEN NULL WHEN len(list_filter(al, lambda x: x <> '0')) > 0 THEN 1 ELSE 0 END AS state FROM st)"""

SQL = {
    "match_candidates": _CAND + " SELECT * FROM cand",
    "scored_candidates": _PUB + " SELECT a, b, kind, round(ro, 9) AS ro, round(profile, 9) AS profile, round(jaccard, 9) AS jaccard, round(containment, 9) AS containment, orientation, score FROM cand",
    "reciprocal_best": _PUB + " SELECT * FROM best",
    "strict_candidates": _STRICT + " SELECT a, b, kind, round(ro, 9) AS ro, round(profile, 9) AS profile, score FROM cand",
    "strict_best": _STRICT + " SELECT * FROM best",
    "match_outcomes": _OUTCOMES + " SELECT * FROM o",
    "unmatched_reasons": _OUTCOMES + " SELECT side, status, reason, confidence, count(*) AS n FROM o GROUP BY ALL",
    "sequence_similarity": """WITH q AS (SELECT doc_id, source, regexp_extract_all(text, '[ACGTN]{60,}') AS l FROM documents WHERE source IS NOT NULL AND text IS NOT NULL), s AS (SELECT doc_id, source, CAST(unnest(range(0, len(l))) AS INTEGER) AS pos, unnest(l) AS seq FROM q),
      n AS (SELECT *, lead(seq) OVER (PARTITION BY source ORDER BY doc_id, pos) AS nxt FROM s),
      b AS (SELECT doc_id, pos, seq, 'next' AS against, nxt AS other FROM n WHERE nxt IS NOT NULL UNION ALL SELECT doc_id, pos, seq, 'stretch', reverse(translate(substring(seq, 11, 40), 'ACGTN', 'TGCAN')) FROM n UNION ALL SELECT doc_id, pos, seq, 'short', substring(seq, 1, 3) FROM n),
      k AS (SELECT *, CAST(greatest(5, least(15, greatest(5, least(length(seq), length(other)) // 3))) AS INTEGER) AS k, reverse(translate(other, 'ACGTN', 'TGCAN')) AS rc FROM b),
      w AS (SELECT *, list_distinct(list_transform(range(1, length(seq) - k + 2), lambda i: substring(seq, i, k))) AS x, CASE WHEN length(other) < k THEN [other] ELSE list_distinct(list_transform(range(1, length(other) - k + 2), lambda i: substring(other, i, k))) END AS y, CASE WHEN length(rc) < k THEN [rc] ELSE list_distinct(list_transform(range(1, length(rc) - k + 2), lambda i: substring(rc, i, k))) END AS z FROM k),
      i AS (SELECT *, len(list_intersect(x, y)) AS i1, len(list_intersect(x, z)) AS i2 FROM w), m AS (SELECT *, (i1 / (len(x) + len(y) - i1), i1 / least(len(x), len(y))) AS f, (i2 / (len(x) + len(z) - i2), i2 / least(len(x), len(z))) AS r FROM i)
      SELECT doc_id, pos, against, round(CASE WHEN r > f THEN r[1] ELSE f[1] END, 9) AS jaccard, round(CASE WHEN r > f THEN r[2] ELSE f[2] END, 9) AS containment, CASE WHEN r > f THEN 'reverse_complement' ELSE 'same' END AS orientation, k FROM m""",
    "capped_evidence": _CAND + " SELECT a, string_agg(b, ';' ORDER BY rn) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rn FROM cand) WHERE rn <= 3 GROUP BY a",
    "fallback_key": """WITH k AS (SELECT doc_id, 0 AS r, source AS c FROM documents UNION ALL SELECT doc_id, 1, split_part(source, '_', 1) || '_log' FROM documents UNION ALL SELECT doc_id, 2, 'mail' FROM documents),
      h AS (SELECT doc_id, min(r) AS key_rank, arg_min(c, r) AS c FROM k JOIN mix_targets ON c = mix_targets.source GROUP BY doc_id) SELECT d.doc_id, c AS t_source, key_rank, target_share FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN mix_targets ON c = mix_targets.source""",
    "parent_resolution": """WITH g AS (SELECT transcript_id AS fid, max(gene_id) AS parent FROM gtf WHERE transcript_id IS NOT NULL AND gene_id IS NOT NULL GROUP BY 1), e AS (SELECT DISTINCT transcript_id AS parent FROM gtf WHERE type = 'exon' AND transcript_id IS NOT NULL) SELECT coalesce(g.parent, e.parent) AS root, count(*) AS n FROM e LEFT JOIN g ON g.fid = e.parent GROUP BY 1""",
    "structure_match": """WITH x AS (SELECT seq_id, strand, gene_id, source, "left" AS l, "right" AS r FROM gtf WHERE type = 'exon' AND gene_id IS NOT NULL AND seq_id IS NOT NULL AND strand IS NOT NULL AND "left" IS NOT NULL AND "right" IS NOT NULL),
      n AS (SELECT seq_id, strand, gene_id, list_sort(list(DISTINCT l || ':' || r)) AS sig FROM x WHERE source IN ('liftset', 'weaver') GROUP BY 1, 2, 3), o AS (SELECT seq_id, strand, gene_id, list_sort(list(DISTINCT l || ':' || r)) AS sig FROM x WHERE source NOT IN ('liftset', 'weaver') GROUP BY 1, 2, 3),
      o2 AS (SELECT seq_id, strand, sig, min(gene_id) AS old_gene FROM o GROUP BY 1, 2, 3) SELECT n.gene_id AS new_gene, old_gene FROM n LEFT JOIN o2 ON n.seq_id = o2.seq_id AND n.strand = o2.strand AND n.sig = o2.sig""",
    "mate_pairs": f"WITH {CALLS}, i AS (SELECT DISTINCT id FROM calls) SELECT l.id[4:] AS base, l.id AS l, r.id AS r FROM i l JOIN i r ON l.id[4:] = r.id[4:] AND l.id LIKE 'lrc%' AND r.id LIKE 'asm%'",
    "kmer_similarity": """WITH d AS (SELECT doc_id, text AS t, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS u FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
      k AS (SELECT doc_id, list_distinct(list_transform(range(1, length(t) - 3), lambda i: substring(t, i, 5))) AS x, list_distinct(list_transform(range(1, length(u) - 3), lambda i: substring(u, i, 5))) AS y FROM d WHERE u IS NOT NULL)
      SELECT doc_id, round(len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0), 9) AS jaccard, round(len(list_intersect(x, y)) / nullif(least(len(x), len(y)), 0), 9) AS containment FROM k""",
    "pair_combinations": "SELECT l.n_nationkey AS a, r.n_nationkey AS b FROM nation l JOIN nation r ON l.n_regionkey = r.n_regionkey AND l.n_nationkey < r.n_nationkey AND length(l.n_name) >= length(r.n_name)",
    "shared_specific": PRES + ", s AS (SELECT nation, count(*) FILTER (n_samples > 1) AS shared, count(*) FILTER (n_samples = 1) AS specific FROM pres JOIN freq USING (item) GROUP BY nation) SELECT *, round(shared * 100.0::DOUBLE / (shared + specific), 9) AS shared_pct, round(specific * 100.0::DOUBLE / (shared + specific), 9) AS specific_pct FROM s",
    "presence_spectrum": PRES + " SELECT r.n AS n_samples, count(item) AS items FROM (SELECT unnest(range(1, 26)) AS n) r LEFT JOIN freq ON n_samples = r.n GROUP BY r.n",
    "family_categories": PRES + ", c AS (SELECT CASE WHEN n_samples = 25 THEN 'Core' WHEN n_samples >= 8 THEN 'Softcore' WHEN n_samples = 1 THEN 'Private' ELSE 'Dispensable' END AS category, count(*) AS items FROM freq GROUP BY 1), k(category) AS (VALUES ('Core'), ('Softcore'), ('Dispensable'), ('Private')) SELECT category, coalesce(items, 0) AS items, round(coalesce(items, 0) * 100.0::DOUBLE / (SELECT sum(items) FROM c), 9) AS pct FROM k LEFT JOIN c USING (category)",
    "category_matrix": PRES + " SELECT nation, count(*) FILTER (n_samples = 25) AS core, count(*) FILTER (n_samples >= 8 AND n_samples < 25) AS softcore, count(*) FILTER (n_samples BETWEEN 2 AND 7) AS dispensable, count(*) FILTER (n_samples = 1) AS private FROM pres JOIN freq USING (item) GROUP BY nation",
    "pan_core_exact": PRES + ", " + _pan_rows() + ", f AS (SELECT n_samples, count(*) AS items FROM freq GROUP BY 1) SELECT CAST(k AS INTEGER) AS k, round(CAST(sum(items * CAST(pw AS DOUBLE)) AS DOUBLE), 6) AS pan, round(CAST(sum(items * CAST(cw AS DOUBLE)) AS DOUBLE), 6) AS core FROM w JOIN f USING (n_samples) GROUP BY k",
    "pan_core_exhaustive": PRES + ", " + _BIT + " SELECT * FROM cur",
    "pan_core_subsets": PRES + ", " + _BIT + " SELECT * FROM cur",
    "pan_core_summary": PRES + ", " + _BIT + " SELECT k, avg(pan) AS pan_mean, CAST(median(pan) AS DOUBLE) AS pan_median, min(pan) AS pan_min, max(pan) AS pan_max, avg(core) AS core_mean, CAST(median(core) AS DOUBLE) AS core_median, min(core) AS core_min, max(core) AS core_max FROM cur GROUP BY k",
    "pan_core_sampled": PRES
    + f""", mk AS (SELECT item, bit_or(1::BIGINT << nation) AS mask FROM pres GROUP BY item), cnt AS (SELECT mask, count(*) AS items FROM mk GROUP BY mask), sub AS (SELECT unnest({P.random_subsets(25, 5, 1)}) AS subset),
      cur AS (SELECT CAST(bit_count(subset) AS INTEGER) AS k, CAST(coalesce(sum(items) FILTER ((mask & subset) <> 0), 0) AS BIGINT) AS pan, CAST(coalesce(sum(items) FILTER ((mask & subset) = subset), 0) AS BIGINT) AS core FROM sub, cnt GROUP BY subset)
      SELECT k, avg(pan) AS pan_mean, CAST(median(pan) AS DOUBLE) AS pan_median, min(pan) AS pan_min, max(pan) AS pan_max, avg(core) AS core_mean, CAST(median(core) AS DOUBLE) AS core_median, min(core) AS core_min, max(core) AS core_max FROM cur GROUP BY k""",
    "mask_jaccard": PRES + ", " + _BIT + ", n AS (SELECT item, mask, lead(mask) OVER (PARTITION BY item % 25 ORDER BY item) AS other FROM mk) SELECT item, round(bit_count(mask & other) / bit_count(mask | other), 9) AS jaccard FROM n WHERE other IS NOT NULL",
    "genotype_states": _GT + " SELECT sample, count(*) FILTER (state = 1) AS present, count(*) FILTER (state = 0) AS absent, count(*) FILTER (state IS NULL) AS missing, count(*) FILTER (replace(gt, '|', '/') IN ('0/1', '1/0', '1/1')) AS strict FROM s GROUP BY sample",
    "sample_state_stats": _GT + ", n AS (SELECT id, count(*) FILTER (state = 1) AS n FROM s GROUP BY id) SELECT sample, count(*) FILTER (state = 1) AS present, count(*) FILTER (state = 0) AS absent, count(*) FILTER (state IS NULL) AS missing, round(count(*) FILTER (state IS NULL) / count(*), 9) AS missing_rate, count(*) FILTER (state = 1 AND n = 1) AS singleton FROM s JOIN n USING (id) GROUP BY sample",
    "combined_states": "WITH o AS (SELECT o_custkey, o_orderpriority, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 0 END AS s FROM orders) SELECT o_custkey, greatest(max(s) FILTER (o_orderpriority < '3'), max(s) FILTER (o_orderpriority >= '3')) AS state FROM o GROUP BY o_custkey",
    "presence_rules": """WITH e AS (SELECT event_type, CASE event_id % 11 WHEN 0 THEN '' WHEN 1 THEN '.' WHEN 2 THEN 'NA' WHEN 3 THEN '0' WHEN 4 THEN '0.0' WHEN 5 THEN '1' WHEN 6 THEN '2' WHEN 7 THEN 'TRUE' WHEN 8 THEN '0/0' WHEN 9 THEN './.' ELSE '0/1' END AS v FROM events)
      SELECT event_type, v, count(*) FILTER (v IN ('1', '2', 'TRUE', '0/1')) AS numeric, count(*) FILTER (v NOT IN ('', '.', 'NA', '0')) AS token, count(*) FILTER (v IN ('1', 'TRUE')) AS truthy, count(*) FILTER (v = '0/1') AS strict FROM e GROUP BY ALL""",
    "orthology_classes": PRES + """, n AS (SELECT item, n_regionkey AS r, count(*) AS c FROM pres JOIN nation ON nation = n_nationkey GROUP BY ALL), g AS (SELECT item, count(*) AS w, max(c) AS mx, min(c) AS mn, coalesce(sum(c) FILTER (r = 0), 0) AS t FROM n GROUP BY item)
      SELECT CASE WHEN w = 5 AND mx = 1 THEN 'single' WHEN t > 0 AND w = 1 THEN 'unique' WHEN w = 5 AND mn > 1 THEN 'multi' WHEN t > 0 THEN 'other' ELSE 'absent' END AS cls, count(*) AS n FROM g GROUP BY 1""",
    "low_copy_families": PRES + ", n AS (SELECT item, n_regionkey AS r, count(*) AS c FROM pres JOIN nation ON nation = n_nationkey GROUP BY ALL) SELECT item FROM n GROUP BY item HAVING count(*) = 5 AND max(c) <= 3",
    "block_orientation": "WITH g AS (SELECT l_orderkey, round(covar_pop(l_linenumber, l_partkey), 9) AS c FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 4) SELECT CASE WHEN c > 0 THEN '+' WHEN c < 0 THEN '-' END AS orientation, count(*) AS n FROM g GROUP BY 1",
}
