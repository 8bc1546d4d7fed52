"""Queries of the problems tagged llm, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.encoding import encode_texts
from loomspan.llm.grouping import match_groups
from loomspan.llm.mixing import mix, mixed_documents, mixture_shares, token_sizes
from loomspan.llm.personal import personal_spans, redact
from loomspan.llm.quantiles import combine, percentiles, summarise
from loomspan.llm.splitting import split_items
from loomspan.runtime import Stored, table

#: Where the queries find the public vocabulary; the operators take it as a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
QS = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of len per type and sample: straight from all rows (scope 'rows'), from the summaries
    of each day of called_at (scope 'day', unknown days as null), and from those days' summaries
    combined ('combined')."""
    keys = ["type", "sample"]
    calls = table(spark, d, "sv_calls").select(*keys, "len", F.to_date("called_at").alias("day"))
    rows = percentiles(combine(summarise(calls, keys, "len"), keys), keys, QS)
    days = Stored(combine(summarise(calls, [*keys, "day"], "len", null_keys=("day",)), [*keys, "day"]), "days").df
    by_day = percentiles(days, [*keys, "day"], QS)
    combined = percentiles(combine(days, keys), keys, QS)
    cols = [*keys, "n", *QS, "rank_error"]
    return (
        rows.select(F.lit("rows").alias("scope"), F.lit(None).cast("date").alias("day"), *cols)
        .unionByName(combined.select(F.lit("combined").alias("scope"), F.lit(None).cast("date").alias("day"), *cols))
        .unionByName(by_day.select(F.lit("day").alias("scope"), "day", *cols))
    )


def p2_overall(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of len per type and sample, straight from all rows."""
    keys = ["type", "sample"]
    return percentiles(combine(summarise(table(spark, d, "sv_calls"), keys, "len"), keys), keys, QS)


def p2_bound_held(spark: SparkSession, d: str) -> DataFrame:
    """Whether every percentile of summaries in buffers of 64 values keeps the bound stated with it, by
    the true ranks; with buffers this small most groups collapse at any scale."""
    keys, size = ["type", "sample"], 64
    calls = table(spark, d, "sv_calls").select(*keys, "len").dropna()
    found = percentiles(combine(summarise(calls, keys, "len", size), keys, size), keys, QS, size)
    long = found.select(*keys, "n", "rank_error", F.inline(F.array(*(F.struct(F.lit(q).alias("q"), F.col(c).alias("value")) for c, q in QS.items()))))
    ranked = calls.groupBy(*keys, "len").count().withColumn("upto", F.sum("count").over(Window.partitionBy(*keys).orderBy("len")))
    met = long.join(ranked.withColumn("value", F.col("len").cast("double")), [*keys, "value"])
    want = F.ceil(F.round(F.col("q") * F.col("n"), 9))
    off = F.greatest(want - F.col("upto"), F.col("upto") - F.col("count") + 1 - want, F.lit(0))
    return met.groupBy(*keys).agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("percentiles"), F.bool_and(off <= F.col("rank_error")).alias("held"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_items(table(spark, d, "chunks"), table(spark, d, "gap_bed"), "chunk_id", "chrom", "start", "end", "chrom", "start")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    kinds = _pieces(spark, d).groupBy("chunk_id").agg(F.count(F.when(F.col("cut") == "forced", 1)).alias("forced"))
    return kinds.select("chunk_id", F.when(F.col("forced") == 0, "natural").otherwise("forced").alias("cut"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Forced cuts of every chunk: the fewest that any division needs."""
    return _pieces(spark, d).groupBy("chunk_id").agg(F.count(F.when(F.col("cut") == "forced", 1)).alias("forced_cuts"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    groups = match_groups(table(spark, d, "sv_matches"), table(spark, d, "sv_calls"), "id_a", "id_b", "id")
    return groups.select("group_id", "id")


def p5_calls(spark: SparkSession, d: str) -> DataFrame:
    """Every call with its group; a call without links is its own group. Repeated calls count once."""
    calls = table(spark, d, "sv_calls").where("id is not null").groupBy("id").agg(F.min(F.struct("chrom", "pos", "type")).alias("c"))
    groups = match_groups(table(spark, d, "sv_matches"), table(spark, d, "sv_calls"), "id_a", "id_b", "id")
    return calls.join(groups, "id", "left").select("id", "c.chrom", "c.pos", "c.type", F.coalesce("group_id", "id").alias("group_id"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"), "text", ["doc_id"], VOCABULARY)


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return token_sizes(table(spark, d, "documents"), table(spark, d, "mix_targets"), VOCABULARY).df


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix(_sizes(spark, d), table(spark, d, "mix_targets"))


def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    """The mixture with the documents' texts and all other columns."""
    return mixed_documents(table(spark, d, "documents"), _sizes(spark, d), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture_shares(_sizes(spark, d), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_spans(table(spark, d, "documents"), table(spark, d, "name_parts"))


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact(table(spark, d, "documents"), table(spark, d, "name_parts"))


QUERIES = {
    f.__name__: f
    for f in (p2_percentiles, p2_overall, p2_bound_held, p3_found, p3_counts, p3_pieces, p5_found, p5_calls, p6_ids, p7_mixture, p7_documents, p7_shares, p8_found, p8_redacted)
}

# up to the buffer size a group is exact, so at the SQL check's scale the bound is 0
_P2_COLS = "type, sample, count(*) AS n, " + ", ".join(f"CAST(quantile_disc(len, {q}) AS DOUBLE) AS {n}" for n, q in QS.items()) + ", CAST(0 AS DOUBLE) AS rank_error"
_P2_FROM = " FROM sv_calls WHERE type IS NOT NULL AND sample IS NOT NULL AND len IS NOT NULL "
_P2_DAY = "CAST(called_at AS DATE)"
_P2_OVERALL = f"SELECT {_P2_COLS}{_P2_FROM}GROUP BY type, sample"
_P2 = f"""
SELECT 'rows' AS scope, CAST(NULL AS DATE) AS day, {_P2_COLS}{_P2_FROM}GROUP BY type, sample
UNION ALL SELECT 'combined', CAST(NULL AS DATE), {_P2_COLS}{_P2_FROM}GROUP BY type, sample
UNION ALL SELECT 'day', {_P2_DAY}, {_P2_COLS}{_P2_FROM}GROUP BY type, sample, {_P2_DAY}
"""

_P3 = """
WITH RECURSIVE o AS (
  SELECT chunk_id, min(chrom) AS chrom, min(least("start", "end")) AS s, min(greatest("start", "end")) AS e FROM chunks
  WHERE chunk_id IS NOT NULL AND "start" IS NOT NULL AND "end" IS NOT NULL AND abs("end" - "start") > 1000000 GROUP BY chunk_id),
b AS (SELECT DISTINCT o.chunk_id, s, e, g."start" AS c FROM o JOIN gap_bed g ON g.chrom = o.chrom AND g."start" > s AND g."start" < e AND g."start" >= s + 20000),
r AS (SELECT chunk_id, c, e FROM b WHERE c - s <= 1000000
  UNION SELECT b.chunk_id, b.c, b.e FROM r JOIN b ON b.chunk_id = r.chunk_id AND b.c > r.c AND b.c - r.c <= 980000)
SELECT chunk_id, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.chunk_id = o.chunk_id AND r.e - r.c <= 980000) THEN 'natural' ELSE 'forced' END AS cut FROM o
"""

# with every boundary used, no division has fewer forced cuts
_P3_COUNTS = """
WITH o AS (
  SELECT chunk_id, min(chrom) AS chrom, min(least("start", "end")) AS s, min(greatest("start", "end")) AS e FROM chunks
  WHERE chunk_id IS NOT NULL AND "start" IS NOT NULL AND "end" IS NOT NULL AND abs("end" - "start") > 1000000 GROUP BY chunk_id),
b AS (SELECT chunk_id, s + 20000 AS c FROM o UNION SELECT chunk_id, e FROM o
  UNION SELECT o.chunk_id, g."start" FROM o JOIN gap_bed g ON g.chrom = o.chrom AND g."start" > s + 20000 AND g."start" < e),
d AS (SELECT chunk_id, c - lag(c) OVER (PARTITION BY chunk_id ORDER BY c) AS gap FROM b)
SELECT chunk_id, CAST(sum((gap + 979999) // 980000 - 1) AS BIGINT) AS forced_cuts FROM d WHERE gap IS NOT NULL GROUP BY chunk_id
"""

_P5 = """
WITH RECURSIVE l AS (
  SELECT DISTINCT id_a AS a, id_b AS b FROM sv_matches WHERE id_a <> id_b AND id_a IN (SELECT id FROM sv_calls) AND id_b IN (SELECT id FROM sv_calls)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS id, a AS g FROM u UNION SELECT u.b, least(r.g, u.b) FROM r JOIN u ON u.a = r.id),
m AS (SELECT id, min(g) AS group_id FROM r GROUP BY id)
"""

SQL = {
    "p2_percentiles": _P2,
    "p2_overall": _P2_OVERALL,
    "p2_bound_held": f"SELECT type, sample, count(*) AS n, {len(QS)} AS percentiles, true AS held{_P2_FROM}GROUP BY type, sample",
    "p3_found": _P3,
    "p3_counts": _P3_COUNTS,
    "p5_found": _P5 + "SELECT group_id, id FROM m",
    "p5_calls": _P5
    + """, c AS (SELECT id, min(row(chrom, pos, type)) AS c FROM sv_calls WHERE id IS NOT NULL GROUP BY id)
SELECT c.id, min(s.chrom) AS chrom, min(s.pos) AS pos, min(s.type) AS type, min(coalesce(m.group_id, c.id)) AS group_id
FROM c JOIN sv_calls s ON s.id = c.id LEFT JOIN m ON m.id = c.id GROUP BY c.id""",
}
