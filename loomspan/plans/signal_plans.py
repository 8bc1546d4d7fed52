"""Interval, island, sweep and signal queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import intervals as I
from loomspan.operators import islands as L
from loomspan.operators import signal as G
from loomspan.operators import sweep as W
from loomspan.operators.matching import best_per
from loomspan.runtime import table

SPAN = I.Span("start", "end")


def _events(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events")
    return t.withColumn("sec", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))


EV = "WITH ev AS (SELECT *, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS sec FROM events)"


def _exons(spark: SparkSession, d: str) -> DataFrame:
    """Exons as half-open intervals with a row id; reversed ones swapped."""
    g = table(spark, d, "gtf").where("type = 'exon' and left is not null and right is not null and seq_id is not null")
    return g.groupBy("seq_id", "gene_id", F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b"), "strand").agg(F.count(F.lit(1)).alias("copies")).select("seq_id", "gene_id", "strand", (F.col("a") - 1).alias("e_start"), F.col("b").alias("e_end"))


EX = """WITH ex AS (SELECT DISTINCT seq_id, gene_id, strand, least("left", "right") - 1 AS e_start, greatest("left", "right") AS e_end FROM gtf
  WHERE type = 'exon' AND "left" IS NOT NULL AND "right" IS NOT NULL AND seq_id IS NOT NULL)"""


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls, each id once, as half-open intervals."""
    c = table(spark, d, "sv_calls").where("pos is not null and end is not null and chrom is not null")
    return c.groupBy("id", "chrom", "pos", "end", "type", "sample").agg(F.max("qual").alias("qual")).select("id", "chrom", "type", "sample", "qual", (F.least("pos", "end") - 1).alias("c_start"), F.greatest("pos", "end").alias("c_end"))


CALLS = """calls AS (SELECT id, chrom, type, sample, max(qual) AS qual, least(pos, "end") - 1 AS c_start, greatest(pos, "end") AS c_end FROM sv_calls
  WHERE pos IS NOT NULL AND "end" IS NOT NULL AND chrom IS NOT NULL GROUP BY id, chrom, pos, "end", type, sample)"""


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gap_bed").select(F.col("chrom").alias("g_chrom"), F.col("start").alias("g_start"), F.col("end").alias("g_end")).where("g_start is not null and g_end is not null").distinct()


GAPS = 'gaps AS (SELECT DISTINCT chrom AS g_chrom, "start" AS g_start, "end" AS g_end FROM gap_bed WHERE "start" IS NOT NULL AND "end" IS NOT NULL)'
CS, GS = I.Span("c_start", "c_end"), I.Span("g_start", "g_end")


def primary_domain(spark: SparkSession, d: str) -> DataFrame:
    """Signal bins above a threshold, clustered by gap, weighted, and the best cluster per axis."""
    ev = _events(spark, d).where("value >= 20").select("user_id", "sec", (F.col("sec") + 60).alias("sec_end"), "value")
    isl = L.merge_islands(ev, ["user_id"], "sec", "sec_end", 3600, "last", [F.max("value").alias("peak"), F.round(F.sum("value"), 6).alias("total")], ties=["value"])
    best = best_per(isl, ["user_id"], [F.desc("total"), "sec"])
    return best.select("user_id", F.col("sec").alias("start_sec"), F.col("sec_end").alias("end_sec"), "n", "peak", "total")


def islands_last(spark, d):
    ev = _events(spark, d).select("user_id", "sec", (F.col("sec") + 600).alias("sec_end"))
    return L.merge_islands(ev, ["user_id"], "sec", "sec_end", 7200, "last").select("user_id", F.col("sec").alias("s"), F.col("sec_end").alias("e"), "n")


def islands_max(spark, d):
    return L.merge_islands(_calls(spark, d), ["chrom", "type"], "c_start", "c_end", 100, "max", ties=["id"]).select("chrom", "type", F.col("c_start").alias("s"), F.col("c_end").alias("e"), "n")


def union_bp(spark, d):
    return L.union_length(_exons(spark, d), ["seq_id"], "e_start", "e_end")


def gap_listing(spark, d):
    return L.list_gaps(_exons(spark, d), ["seq_id"], "e_start", "e_end", 5000)


def interval_overlap(spark, d):
    return I.overlap_join(_calls(spark, d), _gaps(spark, d), [("chrom", "g_chrom")], CS, GS).select("id", "chrom", "c_start", "c_end", "g_start", "g_end", "overlap")


def overlap_clipped_bp(spark, d):
    j = I.overlap_join(_calls(spark, d), _gaps(spark, d), [("chrom", "g_chrom")], CS, GS)
    return j.groupBy("type").agg(F.sum("overlap").alias("bp"), F.count(F.lit(1)).alias("pairs"))


def overlap_semi(spark, d):
    return I.overlap_semi(_calls(spark, d), _gaps(spark, d), [("chrom", "g_chrom")], CS, GS, "id").select("id")


def overlap_anti(spark, d):
    return I.overlap_semi(_calls(spark, d), _gaps(spark, d), [("chrom", "g_chrom")], CS, GS, "id", anti=True).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def overlap_largest(spark, d):
    return I.largest_overlap(_calls(spark, d), _gaps(spark, d), [("chrom", "g_chrom")], CS, GS, "id", [F.col("g_start"), F.col("g_end")]).select("id", "g_start", "g_end", "overlap")


def containment_join(spark, d):
    """Gaps fully inside a call."""
    j = I.overlap_join(_calls(spark, d), _gaps(spark, d), [("chrom", "g_chrom")], CS, GS)
    return j.where("c_start <= g_start and g_end <= c_end").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def lift_over(spark, d):
    """Gap starts lifted through chunks as blocks, minus strand for every other chromosome."""
    c = table(spark, d, "chunks").where("chrom is not null and start is not null and end is not null and start < end").select("chrom", "start", "end").distinct()
    blocks = c.select(F.col("chrom").alias("q_name"), F.col("start").alias("q_start"), F.col("end").alias("q_end"), F.concat(F.lit("t_"), "chrom").alias("t_name"), (F.col("start") + 1000).alias("t_start"), (F.col("end") + 1000).alias("t_end"), F.when(F.length("chrom") % 2 == 0, "+").otherwise("-").alias("block_strand"))
    points = _gaps(spark, d).withColumn("gid", F.concat_ws(":", "g_chrom", F.col("g_start").cast("string"), F.col("g_end").cast("string")))
    return I.lift_over(points, blocks, "gid", [("g_chrom", "q_name")], GS)


def nearest_feature(spark, d):
    """Nearest gap of every call's start, signed by side."""
    pts = _calls(spark, d).select("id", "chrom", "c_start")
    feats = _gaps(spark, d).select(F.col("g_chrom").alias("chrom"), F.col("g_start").alias("s"), F.col("g_end").alias("e"))
    merged = L.merge_islands(feats, ["chrom"], "s", "e").withColumn("fid", F.col("s"))
    return I.nearest(pts, merged, ["chrom"], "c_start", "id", I.Span("s", "e"), "fid")


def flank_neighbours(spark, d):
    pts = _calls(spark, d).select("id", "chrom", "c_start", "c_end")
    f = _gaps(spark, d).select(F.col("g_chrom").alias("chrom"), F.col("g_start").alias("s"), F.col("g_end").alias("e"), F.concat_ws(":", F.col("g_start").cast("string"), F.col("g_end").cast("string")).alias("gap"))
    return I.flank_neighbours(pts, f, ["chrom"], CS, "id", I.Span("s", "e"), "gap", 200_000, 2)


def strand_flanks(spark, d):
    """Gaps in the 10 kb up- and downstream windows of genes."""
    g = _exons(spark, d).where("gene_id is not null and strand in ('+','-')").groupBy("seq_id", "gene_id", "strand").agg(F.min("e_start").alias("s"), F.max("e_end").alias("e"))
    w = I.strand_flanks(g, I.Span("s", "e"), "strand", 10_000)
    w = w.select("seq_id", "gene_id", "strand", F.inline(F.array(F.struct(F.lit("up").alias("side"), F.col("up_start").alias("ws"), F.col("up_end").alias("we")), F.struct(F.lit("down").alias("side"), F.col("down_start").alias("ws"), F.col("down_end").alias("we")))))
    return I.overlap_join(w, _gaps(spark, d), [("seq_id", "g_chrom")], I.Span("ws", "we"), GS).groupBy("side").agg(F.count(F.lit(1)).alias("pairs"), F.sum("overlap").alias("bp"))


def nearest_ordinal(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("at"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_custkey", F.col("c_acctbal").alias("x"))
    return I.nearest_ordinal(c, o, ["o_custkey"], "x", "c_custkey", "at", "o_orderkey")


def priority_sweep(spark, d):
    return W.priority_bp(_calls(spark, d), ["chrom"], "type", "c_start", "c_end", ["INV", "DUP", "DEL", "CNV"])


def coverage_depth(spark, d):
    seg = W.depth_segments(_exons(spark, d), ["seq_id"], "e_start", "e_end")
    return seg.groupBy("depth").agg(F.sum(F.col("seg_end") - F.col("seg_start")).alias("bp"), F.count(F.lit(1)).alias("segments"))


def painting(spark, d):
    """First writer wins inside the chunks of three genomes."""
    regions = table(spark, d, "chunks").where("chrom is not null and start < end").groupBy("chunk_id").agg(F.min("chrom").alias("chrom"), F.min("start").alias("rs"), F.max("end").alias("re"))
    it = I.overlap_join(regions, _gaps(spark, d), [("chrom", "g_chrom")], I.Span("rs", "re"), GS).select("chunk_id", "g_start", "g_end", F.when((F.col("g_end") - F.col("g_start")) > 1000, "long").otherwise("short").alias("cls"))
    return W.paint(it, regions, "chunk_id", "rs", "re", "g_start", "g_end", "cls", ["g_start", "g_end"])


def dominant_class(spark, d):
    bp = W.priority_bp(_calls(spark, d), ["chrom"], "type", "c_start", "c_end", ["INV", "DUP", "DEL", "CNV"])
    return W.dominant_class(bp, ["chrom"], "owner", "bp", ["INV", "DUP", "DEL", "CNV"]).select("chrom", "owner", "bp")


def methylation_windows(spark, d):
    ev = _events(spark, d)
    return G.ratio_windows(ev, ["user_id"], "sec", F.when(F.col("event_type") == "click", 1).otherwise(0), F.when(F.col("event_type").isin("click", "view"), 1).otherwise(0), 86400)


def weighted_window_mean(spark, d):
    ev = _events(spark, d).withColumn("win", G.window_start(F.col("sec"), 3600))
    return ev.groupBy("event_type", "win").agg(F.round(G.weighted_mean(F.col("value"), F.col("user_id")), 6).alias("wmean"))


def feature_density(spark, d):
    return G.feature_density(_exons(spark, d), ["seq_id"], "e_start", "e_end", 1_000_000)


def region_signal(spark, d):
    """Exon-piece signal (score by length) inside chunks."""
    merged = L.merge_islands(_exons(spark, d), ["seq_id"], "e_start", "e_end").withColumn("value", (F.col("n") - 2).cast("double"))
    regions = table(spark, d, "chunks").where("chrom is not null and start < end").groupBy("chunk_id").agg(F.min("chrom").alias("chrom"), F.min("start").alias("rs"), F.max("end").alias("re"))
    out = G.region_stats(merged, regions, [("seq_id", "chrom")], I.Span("e_start", "e_end"), I.Span("rs", "re"), "chunk_id", "value")
    return out.select("chunk_id", "covered_bp", F.round("mean", 9).alias("mean"), "low", "high", F.round("covered_fraction", 9).alias("covered_fraction"), F.round("positive_fraction", 9).alias("positive_fraction"), F.round("negative_fraction", 9).alias("negative_fraction"))


def enrichment(spark, d):
    ev = _events(spark, d).groupBy("user_id", G.window_start(F.col("sec"), 86400).alias("win")).agg(F.count_if(F.col("event_type") == "error").alias("chip"), F.count_if(F.col("event_type") == "view").alias("control"))
    return G.enrichment(ev, ["user_id", "win"], "chip", "control").select("user_id", "win", F.round("log2_enrichment", 9).alias("log2_enrichment"))


def zip_windows(spark, d):
    ev = _events(spark, d)
    a = ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_all"))
    b = ev.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("n_click"))
    return G.zip_windows(a, b, ["user_id"]).select("user_id", "n_all", "n_click")


def share_in_regions(spark, d):
    pts = _calls(spark, d).select("id", "chrom", "c_start")
    ch = table(spark, d, "chunks").where("chrom is not null and start < end").select("chrom", "start", "end").distinct()
    return G.share_in_regions(pts, ch, ("chrom", "chrom"), "c_start", SPAN, "id")


def overlap_fractions(spark, d):
    regions = table(spark, d, "chunks").where("chrom is not null and start < end").groupBy("chunk_id").agg(F.min("chrom").alias("chrom"), F.min("start").alias("rs"), F.max("end").alias("re"))
    f = _calls(spark, d).select(F.col("chrom").alias("f_chrom"), "type", "c_start", "c_end")
    return G.overlap_fractions(regions, f, ("chrom", "f_chrom"), I.Span("rs", "re"), CS, "chunk_id", "type").select("chunk_id", "type", F.round("fraction", 9).alias("fraction"))


def rolling_mean(spark, d):
    ev = _events(spark, d)
    return ev.select("event_id", F.round(L.rolling_mean("value", ["user_id"], ["ts", "event_id"]), 9).alias("truncated"), F.round(L.rolling_mean("value", ["user_id"], ["ts", "event_id"], zero_padded=True), 9).alias("padded"))


def local_maxima(spark, d):
    return L.local_maxima(_events(spark, d), ["user_id"], ["ts", "event_id"], "value").select("event_id")


def seed_extend(spark, d):
    ev = _events(spark, d).withColumn("sec_end", F.col("sec") + 1)
    return L.seed_extend(ev, ["user_id"], ["ts", "event_id"], "value", "sec", "sec_end").select("user_id", "sec", "sec_end", "peak", F.round("mean_score", 9).alias("mean_score"), "bins")


def run_merge(spark, d):
    li = table(spark, d, "lineitem").withColumn("k", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    out = L.run_merge(li, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "l_returnflag", [F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first_order")])
    return out.groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("runs"), F.max("n").alias("longest"))


def junctions(spark, d):
    ev = _events(spark, d)
    return L.junctions(ev, ["user_id"], ["ts", "event_id"], "event_type").groupBy("event_type", "next_value").agg(F.count(F.lit(1)).alias("n"))


def flanked_inserts(spark, d):
    return L.flanked_inserts(_events(spark, d), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "event_type", "prev_value")


def fill_gaps(spark, d):
    merged = L.merge_islands(_exons(spark, d), ["seq_id"], "e_start", "e_end", 20_000).withColumns({"cls": F.when(F.col("n") > 3, "dense").otherwise("sparse"), "len": F.lit(100_000_000).cast("bigint")})
    return L.fill_gaps(merged, ["seq_id"], "e_start", "e_end", "cls", "len").select("seq_id", "cls", F.col("e_start").alias("s"), F.col("e_end").alias("e"))


def n50(spark, d):
    c = table(spark, d, "sv_calls").where("len is not null and type is not null")
    return L.n50(c, ["type"], "len")


QUERIES = {
    f.__name__: f
    for f in (
        primary_domain, islands_last, islands_max, union_bp, gap_listing, interval_overlap, overlap_clipped_bp, overlap_semi, overlap_anti, overlap_largest, containment_join, lift_over, nearest_feature, flank_neighbours, strand_flanks, nearest_ordinal,
        priority_sweep, coverage_depth, painting, dominant_class, methylation_windows, weighted_window_mean, feature_density, region_signal, enrichment, zip_windows, share_in_regions, overlap_fractions, rolling_mean, local_maxima, seed_extend, run_merge, junctions, flanked_inserts, fill_gaps, n50,
    )
}

_W = "PARTITION BY user_id ORDER BY ts, event_id"
_PAIR = f"WITH {CALLS}, {GAPS}, j AS (SELECT *, least(c_end, g_end) - greatest(c_start, g_start) AS overlap FROM calls JOIN gaps ON chrom = g_chrom AND c_start < g_end AND g_start < c_end)"
_REG = "reg AS (SELECT chunk_id, min(chrom) AS chrom, min(\"start\") AS rs, max(\"end\") AS re FROM chunks WHERE chrom IS NOT NULL AND \"start\" < \"end\" GROUP BY chunk_id)"


def _isl(src: str, keys: str, s: str, e: str, gap: int, order: str, pre: str = "", rule: str = "max") -> str:
    """Common table expressions m (rows with island) for a source."""
    prev = f"lag({e}) OVER (PARTITION BY {keys} ORDER BY {order})" if rule == "last" else f"max({e}) OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"{pre}pv AS (SELECT *, {prev} AS pv FROM {src}), m AS (SELECT *, sum(CASE WHEN pv IS NULL OR {s} - pv > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS isl FROM pv)"


_SWEEP = f"""WITH {CALLS}, c2 AS (SELECT * FROM calls WHERE type IN ('INV','DUP','DEL','CNV')),
ev AS (SELECT chrom, c_start AS pos, type, 1 AS d FROM c2 UNION ALL SELECT chrom, c_end, type, -1 FROM c2),
ap AS (SELECT chrom, pos, sum(d) FILTER (type = 'INV') AS a, sum(d) FILTER (type = 'DUP') AS b, sum(d) FILTER (type = 'DEL') AS c, sum(d) FILTER (type = 'CNV') AS e FROM ev GROUP BY chrom, pos),
rn AS (SELECT chrom, pos, lead(pos) OVER w AS nxt, sum(coalesce(a, 0)) OVER w AS ra, sum(coalesce(b, 0)) OVER w AS rb, sum(coalesce(c, 0)) OVER w AS rc, sum(coalesce(e, 0)) OVER w AS re FROM ap WINDOW w AS (PARTITION BY chrom ORDER BY pos)),
ow AS (SELECT chrom, nxt - pos AS bp, CASE WHEN ra > 0 THEN 'INV' WHEN rb > 0 THEN 'DUP' WHEN rc > 0 THEN 'DEL' WHEN re > 0 THEN 'CNV' END AS owner FROM rn WHERE nxt IS NOT NULL),
pb AS (SELECT chrom, owner, CAST(sum(bp) AS BIGINT) AS bp FROM ow WHERE owner IS NOT NULL GROUP BY chrom, owner)
"""

SQL = {
    "primary_domain": EV + ", e AS (SELECT user_id, sec, sec + 60 AS sec_end, value FROM ev WHERE value >= 20)," + _isl("e", "user_id", "sec", "sec_end", 3600, "sec, sec_end, value", rule="last")
    + ", g AS (SELECT user_id, isl, min(sec) AS start_sec, max(sec_end) AS end_sec, count(*) AS n, max(value) AS peak, round(sum(value), 6) AS total FROM m GROUP BY user_id, isl) SELECT user_id, start_sec, end_sec, n, peak, total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, start_sec) AS rn FROM g) WHERE rn = 1",
    "islands_last": EV + ", e AS (SELECT user_id, sec, sec + 600 AS sec_end FROM ev)," + _isl("e", "user_id", "sec", "sec_end", 7200, "sec, sec_end", rule="last") + " SELECT user_id, min(sec) AS s, max(sec_end) AS e, count(*) AS n FROM m GROUP BY user_id, isl",
    "islands_max": f"WITH {CALLS}," + _isl("calls", "chrom, type", "c_start", "c_end", 100, "c_start, c_end, id") + " SELECT chrom, type, min(c_start) AS s, max(c_end) AS e, count(*) AS n FROM m GROUP BY chrom, type, isl",
    "union_bp": EX + "," + _isl("ex", "seq_id", "e_start", "e_end", 0, "e_start, e_end") + ", g AS (SELECT seq_id, isl, max(e_end) - min(e_start) AS bp FROM m GROUP BY seq_id, isl) SELECT seq_id, CAST(sum(bp) AS BIGINT) AS bp FROM g GROUP BY seq_id",
    "gap_listing": EX + "," + _isl("ex", "seq_id", "e_start", "e_end", 0, "e_start, e_end") + ", g AS (SELECT seq_id, isl, min(e_start) AS s, max(e_end) AS e FROM m GROUP BY seq_id, isl), h AS (SELECT seq_id, lag(e) OVER (PARTITION BY seq_id ORDER BY s) AS gap_start, s AS gap_end FROM g) SELECT * FROM h WHERE gap_end - gap_start >= 5000",
    "interval_overlap": _PAIR + " SELECT id, chrom, c_start, c_end, g_start, g_end, overlap FROM j",
    "overlap_clipped_bp": _PAIR + " SELECT type, CAST(sum(overlap) AS BIGINT) AS bp, count(*) AS pairs FROM j GROUP BY type",
    "overlap_semi": f"WITH {CALLS}, {GAPS} SELECT id FROM calls WHERE EXISTS (SELECT 1 FROM gaps WHERE chrom = g_chrom AND c_start < g_end AND g_start < c_end)",
    "overlap_anti": f"WITH {CALLS}, {GAPS} SELECT type, count(*) AS n FROM calls WHERE NOT EXISTS (SELECT 1 FROM gaps WHERE chrom = g_chrom AND c_start < g_end AND g_start < c_end) GROUP BY type",
    "overlap_largest": _PAIR + " SELECT id, g_start, g_end, overlap FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY overlap DESC, g_start, g_end) AS rn FROM j) WHERE rn = 1",
    "containment_join": _PAIR + " SELECT id, count(*) AS n FROM j WHERE c_start <= g_start AND g_end <= c_end GROUP BY id",
    "lift_over": f"""WITH {GAPS}, b AS (SELECT DISTINCT chrom, "start" AS qs, "end" AS qe FROM chunks WHERE chrom IS NOT NULL AND "start" IS NOT NULL AND "end" IS NOT NULL AND "start" < "end"),
      p AS (SELECT g_chrom || ':' || g_start || ':' || g_end AS gid, * FROM gaps), j AS (SELECT p.gid, b.chrom, qs, qe, g_start, g_end FROM p LEFT JOIN b ON b.chrom = p.g_chrom AND qs <= g_start AND g_end <= qe),
      c AS (SELECT gid, count(chrom) AS n, min(chrom) AS chrom, min(qs) AS qs, min(qe) AS qe, min(g_start) AS s, min(g_end) AS e FROM j GROUP BY gid)
      SELECT gid, CASE WHEN n = 1 THEN 'lifted' WHEN n > 1 THEN 'ambiguous' ELSE 'no_block' END AS status, CASE WHEN n = 1 THEN 't_' || chrom END AS t_name,
      CASE WHEN n = 1 THEN CASE WHEN length(chrom) % 2 = 0 THEN qs + 1000 + s - qs ELSE qe + 1000 - (e - qs) END END AS lifted_start,
      CASE WHEN n = 1 THEN CASE WHEN length(chrom) % 2 = 0 THEN qs + 1000 + e - qs ELSE qe + 1000 - (s - qs) END END AS lifted_end FROM c""",
    "nearest_feature": f"WITH {CALLS}, {GAPS}," + _isl("gaps", "g_chrom", "g_start", "g_end", 0, "g_start, g_end") + """, f AS (SELECT g_chrom, min(g_start) AS s, max(g_end) AS e FROM m GROUP BY g_chrom, isl),
      j AS (SELECT id, s, e, CASE WHEN c_start >= s AND c_start < e THEN 0 WHEN e <= c_start THEN c_start - e + 1 ELSE s - c_start END AS dist, CASE WHEN c_start >= s AND c_start < e THEN 0 WHEN e <= c_start THEN 1 ELSE 2 END AS o FROM calls LEFT JOIN f ON chrom = g_chrom),
      r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, o, s) AS rn FROM j)
      SELECT id, s AS nearest_fid, CAST(dist AS BIGINT) AS distance, CASE WHEN s IS NULL THEN NULL ELSE CASE o WHEN 0 THEN 'inside' WHEN 1 THEN 'left' ELSE 'right' END END AS side, CAST(CASE o WHEN 0 THEN 0 WHEN 1 THEN dist ELSE -dist END AS BIGINT) AS signed FROM r WHERE rn = 1""",
    "flank_neighbours": f"""WITH {CALLS}, {GAPS}, j AS (SELECT id, CASE WHEN g_end <= c_start THEN 'left' WHEN g_start >= c_end THEN 'right' END AS side, CASE WHEN g_end <= c_start THEN c_start - g_end ELSE g_start - c_end END AS distance, g_start || ':' || g_end AS gap
      FROM calls JOIN gaps ON chrom = g_chrom AND g_start < c_end + 200000 AND c_start - 200000 < g_end), r AS (SELECT *, row_number() OVER (PARTITION BY id, side ORDER BY distance, gap) AS "rank" FROM j WHERE side IS NOT NULL)
      SELECT id, side, CAST("rank" AS INTEGER) AS "rank", gap, distance FROM r WHERE "rank" <= 2""",
    "strand_flanks": EX + f""", {GAPS}, g AS (SELECT seq_id, gene_id, strand, min(e_start) AS s, max(e_end) AS e FROM ex WHERE gene_id IS NOT NULL AND strand IN ('+', '-') GROUP BY ALL),
      w AS (SELECT seq_id, gene_id, CASE WHEN strand = '+' THEN 'up' ELSE 'down' END AS side, greatest(s - 10000, 0) AS ws, s AS we FROM g UNION ALL SELECT seq_id, gene_id, CASE WHEN strand = '+' THEN 'down' ELSE 'up' END, e, e + 10000 FROM g)
      SELECT side, count(*) AS pairs, CAST(sum(least(we, g_end) - greatest(ws, g_start)) AS BIGINT) AS bp FROM w JOIN gaps ON seq_id = g_chrom AND ws < g_end AND g_start < we GROUP BY side""",
    "nearest_ordinal": "WITH j AS (SELECT c_custkey, o_orderkey, abs(o_totalprice - c_acctbal) AS distance, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(o_totalprice - c_acctbal), o_totalprice, o_orderkey) AS rn FROM customer LEFT JOIN orders ON c_custkey = o_custkey) SELECT c_custkey, o_orderkey, distance FROM j WHERE rn = 1",
    "priority_sweep": _SWEEP + "SELECT chrom, owner, bp FROM pb",
    "coverage_depth": EX + """, ev AS (SELECT seq_id, e_start AS pos, 1 AS d FROM ex UNION ALL SELECT seq_id, e_end, -1 FROM ex), ap AS (SELECT seq_id, pos, sum(d) AS d FROM ev GROUP BY seq_id, pos),
      s AS (SELECT seq_id, pos, lead(pos) OVER w AS nxt, sum(d) OVER w AS depth FROM ap WINDOW w AS (PARTITION BY seq_id ORDER BY pos))
      SELECT CAST(depth AS BIGINT) AS depth, CAST(sum(nxt - pos) AS BIGINT) AS bp, count(*) AS segments FROM s WHERE depth > 0 AND nxt IS NOT NULL GROUP BY depth""",
    "painting": f"""WITH {GAPS}, {_REG}, it AS (SELECT chunk_id, rs, re, greatest(g_start, rs) AS s, least(g_end, re) AS e, g_start, g_end, CASE WHEN g_end - g_start > 1000 THEN 'long' ELSE 'short' END AS cls FROM reg JOIN gaps ON chrom = g_chrom AND g_start < re AND rs < g_end),
      cuts AS (SELECT chunk_id, s AS pos FROM it UNION SELECT chunk_id, e FROM it UNION SELECT chunk_id, rs FROM reg UNION SELECT chunk_id, re FROM reg), seg AS (SELECT chunk_id, pos, lead(pos) OVER (PARTITION BY chunk_id ORDER BY pos) AS nxt FROM cuts),
      o AS (SELECT seg.chunk_id, seg.pos, seg.nxt, arg_min(cls, row(g_start, g_end, cls)) AS cls FROM seg LEFT JOIN it ON it.chunk_id = seg.chunk_id AND it.s <= seg.pos AND seg.nxt <= it.e WHERE seg.nxt IS NOT NULL GROUP BY ALL)
      SELECT chunk_id, coalesce(cls, 'Others') AS cls, CAST(sum(nxt - pos) AS BIGINT) AS bp FROM o GROUP BY ALL""",
    "dominant_class": _SWEEP + "SELECT chrom, owner, bp FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY bp DESC, list_position(['INV','DUP','DEL','CNV'], owner)) AS rn FROM pb) WHERE rn = 1",
    "methylation_windows": EV + ", g AS (SELECT user_id, CAST(floor(sec / 86400.0) * 86400 AS BIGINT) AS win_start, count(*) FILTER (event_type = 'click') AS hits, count(*) FILTER (event_type IN ('click', 'view')) AS total FROM ev GROUP BY ALL) SELECT *, hits / total AS ratio FROM g WHERE total > 0",
    "weighted_window_mean": EV + " SELECT event_type, CAST(floor(sec / 3600.0) * 3600 AS BIGINT) AS win, round(sum(value * user_id) / nullif(sum(user_id), 0), 6) AS wmean FROM ev GROUP BY ALL",
    "feature_density": EX + "," + _isl("ex", "seq_id", "e_start", "e_end", 0, "e_start, e_end") + """, u AS (SELECT seq_id, min(e_start) AS s, max(e_end) AS e FROM m GROUP BY seq_id, isl),
      w AS (SELECT seq_id, s, e, unnest(range(s // 1000000, (e - 1) // 1000000 + 1)) * 1000000 AS win_start FROM u), c AS (SELECT seq_id, win_start, CAST(sum(least(e, win_start + 1000000) - greatest(s, win_start)) AS BIGINT) AS covered FROM w GROUP BY ALL),
      f AS (SELECT seq_id, (e_start // 1000000) * 1000000 AS win_start, count(*) AS features FROM ex GROUP BY ALL)
      SELECT seq_id, win_start, covered, coalesce(features, 0) AS features, coalesce(features, 0) * 1e0 AS per_mb, covered / 1000000 AS fraction FROM c LEFT JOIN f USING (seq_id, win_start)""",
    "region_signal": EX + "," + _isl("ex", "seq_id", "e_start", "e_end", 0, "e_start, e_end") + f""", u AS (SELECT seq_id, min(e_start) AS s, max(e_end) AS e, CAST(count(*) - 2 AS DOUBLE) AS v FROM m GROUP BY seq_id, isl), {_REG},
      j AS (SELECT chunk_id, v, re - rs AS w, least(e, re) - greatest(s, rs) AS ov FROM u JOIN reg ON seq_id = chrom AND s < re AND rs < e)
      SELECT chunk_id, CAST(sum(ov) AS BIGINT) AS covered_bp, round(sum(v * ov) / sum(ov), 9) AS mean, min(v) AS low, max(v) AS high, round(sum(ov) / min(w), 9) AS covered_fraction, round(coalesce(sum(ov) FILTER (v > 0), 0) / min(w), 9) AS positive_fraction, round(coalesce(sum(ov) FILTER (v < 0), 0) / min(w), 9) AS negative_fraction FROM j GROUP BY chunk_id""",
    "enrichment": EV + """, g AS (SELECT user_id, CAST(floor(sec / 86400.0) * 86400 AS BIGINT) AS win, count(*) FILTER (event_type = 'error') AS chip, count(*) FILTER (event_type = 'view') AS control FROM ev GROUP BY ALL), t AS (SELECT sum(chip) AS tc, sum(control) AS ti FROM g)
      SELECT user_id, win, round(log2((chip * 1e6 / tc + 0.25) / (control * 1e6 / ti + 0.25)), 9) AS log2_enrichment FROM g, t""",
    "zip_windows": "SELECT user_id, count(*) AS n_all, count(*) FILTER (event_type = 'click') AS n_click FROM events GROUP BY user_id",
    "share_in_regions": f"""WITH {CALLS}, p AS (SELECT id, EXISTS (SELECT 1 FROM chunks k WHERE k.chrom = calls.chrom AND k."start" < k."end" AND k."start" <= c_start AND c_start < k."end") AS inn FROM calls) SELECT count(*) AS points, count(*) FILTER (inn) AS inside, count(*) FILTER (inn) / count(*) AS share FROM p""",
    "overlap_fractions": f"WITH {CALLS}, {_REG}, j AS (SELECT chunk_id, type, re - rs AS w, greatest(c_start, rs) AS s, least(c_end, re) AS e FROM reg JOIN calls USING (chrom) WHERE c_start < re AND rs < c_end)," + _isl("j", "chunk_id, type", "s", "e", 0, "s, e")
    + ", u AS (SELECT chunk_id, type, min(w) AS w, max(e) - min(s) AS bp FROM m GROUP BY chunk_id, type, isl) SELECT chunk_id, type, round(sum(bp) / min(w), 9) AS fraction FROM u GROUP BY ALL",
    "rolling_mean": f"SELECT event_id, round(avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS truncated, round(sum(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 9) AS padded FROM events WINDOW w AS ({_W})",
    "local_maxima": f"SELECT event_id FROM (SELECT event_id, value, lag(value) OVER ({_W}) AS p, lead(value) OVER ({_W}) AS n FROM events) WHERE (p IS NULL OR value >= p) AND (n IS NULL OR value >= n)",
    "seed_extend": EV + f""", t AS (SELECT *, value >= greatest(0.25, 0.35 * max(value) OVER (PARTITION BY user_id)) AS inn FROM ev), l AS (SELECT *, lag(inn) OVER ({_W}) AS pi FROM t),
      r AS (SELECT *, sum(CASE WHEN inn IS NOT DISTINCT FROM pi THEN 0 ELSE 1 END) OVER ({_W}) AS run FROM l), g AS (SELECT user_id, run, min(sec) AS sec, max(sec) + 1 AS sec_end, max(value) AS peak, round(avg(value), 9) AS mean_score, count(*) AS bins FROM r WHERE inn GROUP BY user_id, run)
      SELECT user_id, sec, sec_end, peak, mean_score, bins FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY peak DESC, sec) AS rn FROM g) WHERE rn = 1""",
    "run_merge": """WITH l AS (SELECT *, lag(l_returnflag) OVER w AS p FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)),
      r AS (SELECT *, sum(CASE WHEN p = l_returnflag THEN 0 ELSE 1 END) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS run FROM l),
      g AS (SELECT l_suppkey, run, l_returnflag, count(*) AS n FROM r GROUP BY ALL) SELECT l_suppkey, l_returnflag, count(*) AS runs, max(n) AS longest FROM g GROUP BY ALL""",
    "junctions": f"WITH l AS (SELECT event_type, lead(event_type) OVER ({_W}) AS next_value FROM events) SELECT event_type, next_value, count(*) AS n FROM l WHERE next_value IS NOT NULL GROUP BY ALL",
    "flanked_inserts": f"WITH l AS (SELECT event_id, event_type, lag(event_type) OVER ({_W}) AS prev_value, lead(event_type) OVER ({_W}) AS n FROM events) SELECT event_id, event_type, prev_value FROM l WHERE prev_value = n AND prev_value <> event_type",
    "fill_gaps": EX + "," + _isl("ex", "seq_id", "e_start", "e_end", 20000, "e_start, e_end") + """, u AS (SELECT seq_id, min(e_start) AS s, max(e_end) AS e, CASE WHEN count(*) > 3 THEN 'dense' ELSE 'sparse' END AS cls FROM m GROUP BY seq_id, isl),
      n AS (SELECT *, lag(e) OVER w AS pe, lead(s) OVER w AS ns, lag(cls) OVER w AS pc FROM u WINDOW w AS (PARTITION BY seq_id ORDER BY s, e)),
      x AS (SELECT seq_id, cls, CASE WHEN pe IS NULL THEN 0 ELSE pe + (s - pe) // 2 END AS a, CASE WHEN ns IS NULL THEN 100000000 ELSE e + (ns - e) // 2 END AS b, sum(CASE WHEN pc = cls THEN 0 ELSE 1 END) OVER (PARTITION BY seq_id ORDER BY s, e) AS run FROM n)
      SELECT seq_id, cls, CAST(min(a) AS BIGINT) AS s, CAST(max(b) AS BIGINT) AS e FROM x GROUP BY seq_id, run, cls""",
    "n50": "WITH t AS (SELECT type, len, sum(len) OVER (PARTITION BY type ORDER BY len DESC) AS r, sum(len) OVER (PARTITION BY type) AS t FROM sv_calls WHERE len IS NOT NULL AND type IS NOT NULL) SELECT type, max(len) AS n50 FROM t WHERE r >= t * 0.5 GROUP BY type",
}
