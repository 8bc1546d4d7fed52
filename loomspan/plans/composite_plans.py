"""Queries of composed operators over the annotation and variant tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import scalars as S
from loomspan.operators import composites as C
from loomspan.operators import islands as L
from loomspan.operators import signal as G
from loomspan.operators.intervals import Span, nearest
from loomspan.plans.signal_plans import CALLS, EX, GAPS, _calls, _exons, _gaps, _isl
from loomspan.runtime import table


def _features(spark: SparkSession, d: str, kind: str) -> DataFrame:
    g = table(spark, d, "gtf").where(F.col("type") == kind).where("seq_id is not null and strand in ('+','-') and left is not null and right is not null")
    return g.select("seq_id", "strand", F.least("left", "right").alias("lo"), F.greatest("left", "right").alias("hi")).distinct()


def _feat(kind: str, name: str) -> str:
    return f"""{name} AS (SELECT DISTINCT seq_id, strand, least("left", "right") AS lo, greatest("left", "right") AS hi FROM gtf WHERE type = '{kind}' AND seq_id IS NOT NULL AND strand IN ('+', '-') AND "left" IS NOT NULL AND "right" IS NOT NULL)"""


def type_rules(spark, d):
    c = table(spark, d, "sv_calls").where("type is not null")
    keep = C.per_type_filter(F.col("type"), {"DEL": F.col("qual") >= 10, "INS": F.col("qual") >= 15, "TRA": F.col("qual") >= 25}, F.col("gt") == "1/1")
    return c.groupBy("type").agg(F.count_if(keep).alias("kept"), F.count(F.lit(1)).alias("n"))


def upstream_supported(spark, d):
    return C.upstream_supported(_features(spark, d, "CDS"), _features(spark, d, "exon"), _features(spark, d, "start_codon"), "seq_id", "lo", "hi", "strand").groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))


def source_demotion(spark, d):
    """Calls of assemblies alone are dropped, those of both sources demoted without support."""
    c = _calls(spark, d).withColumn("src", F.substring("id", 1, 3))
    out = C.demote(c, "src", F.col("qual") >= 20, ["asm"], {"lrc": "pbx"})
    n = F.col("c_end") % 4
    label = F.when(F.col("src") == "asm", S.assembly_confidence(F.col("type"), n)).otherwise(S.read_confidence(F.when(F.col("qual") >= 30, "high").when(F.col("qual") >= 10, "medium"), n))
    return out.withColumn("label", label).groupBy("src", "decision", "new_source", "label").agg(F.count(F.lit(1)).alias("n"))


def consensus_domains(spark, d):
    """Per chromosome and sample three calls of one domain (its longest DEL, DUP and INV), made one."""
    c = _calls(spark, d).where("type in ('DEL', 'DUP', 'INV') and sample is not null")
    top = c.groupBy("chrom", "sample").agg(*(F.max(F.when(F.col("type") == t, F.struct(F.col("c_end") - F.col("c_start"), F.col("c_start").alias("s"), F.col("c_end").alias("e")))).alias(t) for t in ("DEL", "DUP", "INV")))
    pair = lambda t: (F.col(f"{t}.s"), F.col(f"{t}.e"))
    return top.select("chrom", "sample", G.consensus_interval(pair("DEL"), pair("DUP"), pair("INV")).alias("x")).select("chrom", "sample", "x.*")


def merged_scope(spark, d):
    """Exons and gaps: bp of their union and its share of a genome of 1 Gb."""
    ex = _exons(spark, d)
    return C.scope_fraction(ex, ["seq_id"], "e_start", "e_end", 1_000_000_000).withColumn("fraction", F.round("fraction", 9))


def nearest_interval(spark, d):
    """The nearest gap of every call as an interval: from its start to the left, from its end to the right."""
    c = _calls(spark, d).select("id", "chrom", "c_start", "c_end").dropDuplicates(["id"])
    g = _gaps(spark, d).select(F.col("g_chrom").alias("chrom"), "g_start", "g_end", F.concat_ws(":", F.col("g_start").cast("string"), F.col("g_end").cast("string")).alias("gap"))
    return nearest(c, g, ["chrom"], "c_start", "id", Span("g_start", "g_end"), "gap", point_end="c_end").select("id", "distance", "side", "signed")


def solo_elements(spark, d):
    c = _calls(spark, d).withColumns({"s": F.col("c_start"), "e": F.col("c_end")})
    full = _gaps(spark, d).select(F.col("g_chrom").alias("chrom"), F.col("g_start").alias("s"), F.col("g_end").alias("e"))
    return C.solo_elements(c.where("type = 'DEL'"), full, c.where("type = 'INV'").select("chrom", "s", "e"), "chrom", "s", "e", "id").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def lock_step(spark, d):
    o = table(spark, d, "orders")
    a = o.select("o_orderkey", F.col("o_orderstatus").alias("v"))
    b = o.select("o_orderkey", F.col("o_orderpriority").alias("v"))
    return C.lock_step({"x": a, "y": b}, "o_orderkey", ["v"]).groupBy("x_v", "y_v").agg(F.count(F.lit(1)).alias("n"))


def chosen_clusters(spark, d):
    cl = L.merge_islands(_exons(spark, d), ["seq_id"], "e_start", "e_end", 50_000).select("seq_id", "e_start", "e_end", F.col("n").alias("score"))
    g = _gaps(spark, d).select(F.col("g_chrom").alias("seq_id"), "g_start", "g_end")
    return C.choose_cluster(cl, g, ["seq_id"], "e_start", "e_end", "score", Span("g_start", "g_end")).select("seq_id", "e_start", "e_end", "score", "overlap", "guided")


def two_hop(spark, d):
    c = table(spark, d, "chunks").where("chrom is not null and start < end").groupBy("chrom").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    first = c.select(F.col("chrom").alias("q_name"), F.col("s").alias("q_start"), F.col("e").alias("q_end"), F.concat(F.lit("x_"), "chrom").alias("t_name"), F.lit(0).cast("bigint").alias("t_start"), (F.col("e") - F.col("s")).alias("t_end"), F.lit("+").alias("block_strand"))
    second = c.select(F.concat(F.lit("x_"), "chrom").alias("q_name"), F.lit(0).cast("bigint").alias("q_start"), (F.col("e") - F.col("s")).alias("q_end"), F.concat(F.lit("y_"), "chrom").alias("t_name"), F.lit(0).cast("bigint").alias("t_start"), (F.col("e") - F.col("s")).alias("t_end"), F.lit("-").alias("block_strand"))
    p = _calls(spark, d).select("id", "chrom", "c_start", "c_end")
    return C.two_hop(p, first, second, "id", "chrom", Span("c_start", "c_end"))


def merged_hits(spark, d):
    return C.merge_hits(_calls(spark, d).where("type is not null"), ["chrom", "sample"], "c_start", "c_end", "type").select("chrom", "sample", F.col("c_start").alias("s"), F.col("c_end").alias("e"), "n", "type")


def track_matrix(spark, d):
    """10-Mb windows with exon coverage, gap coverage and mean gap score."""
    ex = _exons(spark, d).select(F.col("seq_id").alias("chrom"), F.col("e_start").alias("s"), F.col("e_end").alias("e"))
    g = table(spark, d, "gap_bed").where("start is not null and end is not null").groupBy("chrom", F.col("start").alias("s"), F.col("end").alias("e")).agg(F.max("score").cast("double").alias("v"))
    w = g.groupBy("chrom").agg(F.max("e").alias("m")).select("chrom", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m"), F.lit(10_000_000).cast("bigint"))).alias("ws")).withColumn("we", F.col("ws") + 10_000_000)
    out = C.track_matrix(w, "chrom", "ws", "we", {"exons": (ex, "s", "e"), "gaps": (g, "s", "e")}, {"gap_score": (g, "s", "e", "v")})
    return out.select("chrom", "ws", F.round("exons", 9).alias("exons"), F.round("gaps", 9).alias("gaps"), F.round("gap_score", 6).alias("gap_score"))


def protein_profile(spark, d):
    """Texts in place of proteins, ids against the documents that have a module."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return C.protein_profile(docs, "doc_id", "text", table(spark, d, "documents").where("module is not null"), "doc_id")


def repeat_decay(spark, d):
    c = _calls(spark, d).where("type is not null")
    out = C.repeat_decay(c, ["chrom"], "c_start", "c_end", "type", "qual", F.lit(100_000_000))
    return out.select("chrom", "fragments", "families", F.round("identity", 6).alias("identity"), "longest", "merged_bp", F.round("coverage", 9).alias("coverage"))


def inside_weights(spark, d):
    pts = _features(spark, d, "start_codon").withColumn("pid", F.concat_ws(":", "seq_id", "strand", F.col("lo").cast("string"), F.col("hi").cast("string")))
    cds = _features(spark, d, "CDS").withColumn("w", F.lit(1).cast("bigint"))
    return C.inside_weight(pts.select("pid", "seq_id", F.col("lo").alias("at")), cds, "seq_id", "at", "lo", "hi", "w", "pid")


def pair_share(spark, d):
    m = table(spark, d, "sv_matches").where("id_a is not null and id_b is not null")
    out = C.pair_share(m.select(F.substring("id_a", 1, 3).alias("a"), F.substring("id_b", 1, 3).alias("b"), "score"), "a", "b", F.coalesce(F.col("score"), F.lit(0.0)) >= 0.5)
    return out.withColumn("pct", F.round("pct", 9))


def expression_divergence(spark, d):
    li = table(spark, d, "lineitem")
    out = C.expression_divergence(li, "l_partkey", "l_returnflag", "A", "R", "l_quantity")
    return out.select("l_partkey", F.round("log2fc", 9).alias("log2fc"), F.round("abs_log2fc", 9).alias("abs_log2fc"))


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")}

SQL = {
    "type_rules": "SELECT type, count(*) FILTER (CASE type WHEN 'DEL' THEN coalesce(qual >= 10, false) WHEN 'INS' THEN coalesce(qual >= 15, false) WHEN 'TRA' THEN coalesce(qual >= 25, false) ELSE false END OR coalesce(gt = '1/1', false)) AS kept, count(*) AS n FROM sv_calls WHERE type IS NOT NULL GROUP BY 1",
    "upstream_supported": f"""WITH {_feat('CDS', 'c')}, {_feat('exon', 'i')}, {_feat('start_codon', 's')}, m AS (SELECT seq_id, strand, CASE WHEN strand = '+' THEN hi + 1 ELSE lo - 1 END AS p FROM i UNION SELECT seq_id, strand, CASE WHEN strand = '+' THEN lo ELSE hi END FROM s)
      SELECT seq_id, count(*) AS n FROM c WHERE EXISTS (SELECT 1 FROM m WHERE m.seq_id = c.seq_id AND m.strand = c.strand AND m.p = CASE WHEN c.strand = '+' THEN lo ELSE hi END) GROUP BY 1""",
    "source_demotion": f"""WITH {CALLS}, x AS (SELECT id[1:3] AS src, type, c_end % 4 AS n, coalesce(qual >= 20, false) AS ok, CASE WHEN qual >= 30 THEN 'high' WHEN qual >= 10 THEN 'medium' ELSE '.' END AS conf FROM calls)
      SELECT src, CASE WHEN src = 'asm' THEN 'drop' WHEN src = 'lrc' AND NOT ok THEN 'demote' ELSE 'keep' END AS decision, CASE WHEN src = 'lrc' AND NOT ok THEN 'pbx' ELSE src END AS new_source,
      CASE WHEN src = 'asm' THEN CASE WHEN type IN ('DEL', 'INS') AND n >= 2 THEN 'medium_svgap_combined' WHEN type IN ('CNV', 'INV', 'TRL') THEN 'medium_svgap_only' ELSE 'low_svgap_only' END WHEN n > 0 AND conf = 'high' THEN 'high_read_svgap_supported' WHEN n > 0 THEN 'medium_read_svgap_supported' ELSE conf END AS label, count(*) AS n FROM x GROUP BY ALL""",
    "consensus_domains": f"""WITH {CALLS}, t AS (SELECT chrom, sample, arg_max((c_start, c_end), (c_end - c_start, c_start, c_end)) FILTER (type = 'DEL') AS a, arg_max((c_start, c_end), (c_end - c_start, c_start, c_end)) FILTER (type = 'DUP') AS b, arg_max((c_start, c_end), (c_end - c_start, c_start, c_end)) FILTER (type = 'INV') AS q FROM calls WHERE type IN ('DEL', 'DUP', 'INV') AND sample IS NOT NULL GROUP BY ALL),
      u AS (SELECT chrom, sample, a[1] AS a1, a[2] AS a2, b[1] AS b1, b[2] AS b2, q[1] AS q1, q[2] AS q2 FROM t), c AS (SELECT *, CASE WHEN a1 IS NOT NULL OR b1 IS NOT NULL THEN least(a1, b1) ELSE q1 END AS c1, CASE WHEN a1 IS NOT NULL OR b1 IS NOT NULL THEN greatest(a2, b2) ELSE q2 END AS c2 FROM u),
      o AS (SELECT *, CASE WHEN q1 IS NULL THEN 0 ELSE greatest(0, least(c2, q2) - greatest(c1, q1)) END AS ov FROM c), j AS (SELECT *, coalesce(q1 IS NOT NULL AND (ov / greatest(1, q2 - q1) >= 0.25 OR ov / greatest(1, c2 - c1) >= 0.25), false) AS joins FROM o)
      SELECT chrom, sample, CASE WHEN joins THEN least(c1, q1) ELSE c1 END AS start, CASE WHEN joins THEN greatest(c2, q2) ELSE c2 END AS "end", concat_ws(',', CASE WHEN a1 IS NOT NULL THEN 'raw' END, CASE WHEN b1 IS NOT NULL THEN 'relaxed' END, CASE WHEN joins THEN 'q20' END) AS used,
      CASE WHEN q1 IS NULL THEN 'missing' WHEN joins THEN 'concordant_or_partly_overlapping' ELSE 'discordant_excluded' END AS status, CAST(ov AS BIGINT) AS overlap,
      concat_ws(';', CASE WHEN a1 IS NOT NULL AND b1 IS NOT NULL THEN CASE WHEN greatest(0, least(a2, b2) - greatest(a1, b1)) / greatest(1, least(a2 - a1, b2 - b1)) >= 0.5 THEN 'raw_relaxed_concordant' ELSE 'raw_relaxed_broad_or_split' END WHEN a1 IS NOT NULL THEN 'raw_only' WHEN b1 IS NOT NULL THEN 'relaxed_only' ELSE 'q20_only' END,
        CASE WHEN joins THEN 'q20_included' WHEN q1 IS NOT NULL THEN 'q20_discordant_excluded' END) AS note FROM j""",
    "merged_scope": EX + "," + _isl("ex", "seq_id", "e_start", "e_end", 0, "e_start, e_end") + ", u AS (SELECT seq_id, isl, max(e_end) - min(e_start) AS bp FROM m GROUP BY 1, 2) SELECT CAST(sum(bp) AS BIGINT) AS bp, round(sum(bp) / 1000000000, 9) AS fraction FROM u",
    "nearest_interval": f"""WITH {CALLS}, {GAPS}, c AS (SELECT DISTINCT id, chrom, c_start, c_end FROM calls), j AS (SELECT id, c_start, c_end, max(g_end) FILTER (g_end <= c_start) AS l, min(g_start) FILTER (g_start >= c_end) AS r, count(*) FILTER (g_start < c_end AND c_start < g_end) AS n FROM c LEFT JOIN gaps ON g_chrom = chrom GROUP BY ALL),
      k AS (SELECT *, c_start + 1 - l AS dl, r - c_end + 1 AS dr FROM j), s AS (SELECT id, CASE WHEN n > 0 THEN 'inside' WHEN dl IS NOT NULL AND (dr IS NULL OR dl <= dr) THEN 'left' WHEN dr IS NOT NULL THEN 'right' END AS side, dl, dr FROM k)
      SELECT id, CASE side WHEN 'inside' THEN 0 WHEN 'left' THEN dl WHEN 'right' THEN dr END AS distance, side, CASE side WHEN 'inside' THEN 0 WHEN 'left' THEN dl WHEN 'right' THEN -dr END AS signed FROM s""",
    "solo_elements": f"""WITH {CALLS}, {GAPS} SELECT CASE WHEN c_end - c_start < 100 THEN 'short' WHEN EXISTS (SELECT 1 FROM gaps WHERE g_chrom = chrom AND g_start < c_end AND c_start < g_end) THEN 'in_complete'
      WHEN EXISTS (SELECT 1 FROM calls i WHERE i.type = 'INV' AND i.chrom = c.chrom AND i.c_start < c.c_end + 20000 AND c.c_start - 20000 < i.c_end) THEN 'near_internal' ELSE 'solo' END AS reason, count(*) AS n FROM calls c WHERE type = 'DEL' GROUP BY 1""",
    "lock_step": "SELECT o_orderstatus AS x_v, o_orderpriority AS y_v, count(*) AS n FROM orders GROUP BY ALL",
    "chosen_clusters": EX + f", {GAPS}," + _isl("ex", "seq_id", "e_start", "e_end", 50000, "e_start, e_end") + """, k AS (SELECT seq_id, min(e_start) AS e_start, max(e_end) AS e_end, count(*) AS score FROM m GROUP BY seq_id, isl),
      o AS (SELECT k.*, CAST(coalesce(sum(least(e_end, g_end) - greatest(e_start, g_start)) FILTER (g_start IS NOT NULL), 0) AS BIGINT) AS overlap FROM k LEFT JOIN gaps ON seq_id = g_chrom AND e_start < g_end AND g_start < e_end GROUP BY ALL)
      SELECT seq_id, e_start, e_end, score, overlap, overlap > 0 AS guided FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY overlap DESC, score DESC, e_start) AS rn FROM o) WHERE rn = 1""",
    "two_hop": f"""WITH {CALLS}, b AS (SELECT chrom AS bc, min("start") AS s, max("end") AS e FROM chunks WHERE chrom IS NOT NULL AND "start" < "end" GROUP BY 1)
      SELECT id, CASE WHEN bc IS NULL THEN 'first_no_block' ELSE 'lifted' END AS status, 'y_' || bc AS t_name, (e - s) - (c_end - s) AS lifted_start, (e - s) - (c_start - s) AS lifted_end FROM calls LEFT JOIN b ON chrom = bc AND s <= c_start AND c_end <= e""",
    "merged_hits": f"WITH {CALLS}, t AS (SELECT * FROM calls WHERE type IS NOT NULL)," + _isl("t", "chrom, sample", "c_start", "c_end", 100, "c_start, c_end, type") + """, k AS (SELECT chrom, sample, isl, type, sum(c_end - c_start) AS bp, min(c_start) AS s, max(c_end) AS e, count(*) AS n FROM m GROUP BY ALL),
      g AS (SELECT chrom, sample, isl, min(s) AS s, max(e) AS e, CAST(sum(n) AS BIGINT) AS n, arg_min(type, row(-bp, type)) AS type FROM k GROUP BY 1, 2, 3) SELECT chrom, sample, s, e, n, type FROM g""",
    "track_matrix": EX + ', gg AS (SELECT chrom, "start" AS s, "end" AS e, CAST(max(score) AS DOUBLE) AS v FROM gap_bed WHERE "start" IS NOT NULL AND "end" IS NOT NULL GROUP BY 1, 2, 3), x AS (SELECT seq_id AS chrom, e_start AS s, e_end AS e FROM ex),' + _isl("x", "chrom", "s", "e", 0, "s, e") + """, xu AS (SELECT chrom, min(s) AS s, max(e) AS e FROM m GROUP BY chrom, isl),
      gp AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv2 FROM gg), gi AS (SELECT *, sum(CASE WHEN pv2 IS NULL OR s > pv2 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM gp), gu AS (SELECT chrom, min(s) AS s, max(e) AS e FROM gi GROUP BY chrom, k),
      w AS (SELECT chrom, unnest(range(0, max(e) + 1, 10000000)) AS ws FROM gg GROUP BY chrom)
      SELECT chrom, ws, round(coalesce((SELECT sum(least(e, ws + 10000000) - greatest(s, ws)) FROM xu WHERE xu.chrom = w.chrom AND s < ws + 10000000 AND ws < e), 0) / 10000000, 9) AS exons,
      round(coalesce((SELECT sum(least(e, ws + 10000000) - greatest(s, ws)) FROM gu WHERE gu.chrom = w.chrom AND s < ws + 10000000 AND ws < e), 0) / 10000000, 9) AS gaps,
      round((SELECT sum(v * (least(e, ws + 10000000) - greatest(s, ws))) / sum(least(e, ws + 10000000) - greatest(s, ws)) FROM gg WHERE v IS NOT NULL AND gg.chrom = w.chrom AND s < ws + 10000000 AND ws < e), 6) AS gap_score FROM w""",
    "protein_profile": r"""WITH p AS (SELECT doc_id, upper(text) AS s, CAST(length(text) AS INTEGER) AS n FROM documents WHERE text IS NOT NULL), g AS (SELECT DISTINCT doc_id FROM documents WHERE module IS NOT NULL)
      SELECT count(*) AS records, count(*) - count(DISTINCT doc_id) AS repeated, count(*) FILTER (regexp_matches(s, '[*.]\z')) AS terminal_stop, count(*) FILTER (regexp_matches(s, '(?s)[*.].')) AS inner_stop, count(*) FILTER (regexp_matches(s, '[^ACDEFGHIKLMNPQRSTVWYXBZUO*.]')) AS invalid,
      min(n) AS shortest, max(n) AS longest, quantile_cont(n, 0.5) AS median_length, (SELECT count(*) FROM p ANTI JOIN g USING (doc_id)) AS only_proteins, (SELECT count(*) FROM g ANTI JOIN p USING (doc_id)) AS only_genes FROM p""",
    "repeat_decay": f"WITH {CALLS}, t AS (SELECT * FROM calls WHERE type IS NOT NULL)," + _isl("t", "chrom", "c_start", "c_end", 20, "c_start, c_end") + """, u AS (SELECT chrom, isl, max(c_end) - min(c_start) AS bp FROM m GROUP BY chrom, isl), v AS (SELECT chrom, CAST(sum(bp) AS BIGINT) AS merged_bp FROM u GROUP BY chrom),
      b AS (SELECT chrom, count(*) AS fragments, count(DISTINCT type) AS families, round(sum(qual * (c_end - c_start)) / sum(CASE WHEN qual IS NOT NULL THEN c_end - c_start END), 6) AS identity, max(c_end - c_start) AS longest FROM t GROUP BY chrom) SELECT b.*, merged_bp, round(merged_bp / 100000000, 9) AS coverage FROM b JOIN v USING (chrom)""",
    "inside_weights": f"WITH {_feat('start_codon', 's')}, {_feat('CDS', 'c')} SELECT s.seq_id || ':' || s.strand || ':' || s.lo || ':' || s.hi AS pid, count(c.lo) AS weight FROM s LEFT JOIN c ON s.seq_id = c.seq_id AND c.lo < s.lo AND s.lo < c.hi GROUP BY s.seq_id, s.strand, s.lo, s.hi",
    "pair_share": "SELECT id_a[1:3] AS a, id_b[1:3] AS b, count(*) FILTER (coalesce(score, 0) >= 0.5) AS matched, count(*) AS total, round(count(*) FILTER (coalesce(score, 0) >= 0.5) * 100.0::DOUBLE / count(*), 9) AS pct FROM sv_matches WHERE id_a IS NOT NULL AND id_b IS NOT NULL GROUP BY 1, 2",
    "expression_divergence": "WITH g AS (SELECT l_partkey, coalesce(avg(l_quantity) FILTER (l_returnflag = 'A'), 0) AS a, coalesce(avg(l_quantity) FILTER (l_returnflag = 'R'), 0) AS b FROM lineitem GROUP BY 1) SELECT l_partkey, round(log2(a + 1) - log2(b + 1), 9) AS log2fc, round(abs(log2(a + 1) - log2(b + 1)), 9) AS abs_log2fc FROM g WHERE a >= 1 OR b >= 1",
}
