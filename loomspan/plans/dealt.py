"""Queries of the general training-data problems (P1 and P4) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators.periods import merge_periods
from loomspan.operators.rejects import CALL_FIELDS, load_files, load_records
from loomspan.runtime import Scratch, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    gtf = table(spark, d, "gtf").where("(type is null or type not in ('gene', 'transcript')) and strand in ('+', '-')")
    return merge_periods(gtf, ["seq_id", "gene_id", "strand"], "left", "right")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = load_records(table(spark, d, "raw_calls"), "raw", CALL_FIELDS, keep=["line_id"])
    return rows.where("reason is not null").select("line_id", "reason")


def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    rows = load_records(table(spark, d, "raw_calls"), "raw", CALL_FIELDS, keep=["line_id"])
    return rows.where("reason is null").select("line_id", *(F.col(f.name) for f in CALL_FIELDS))


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    """The records that are no rejects for their quoting, written to text files and loaded from these."""
    raw = load_records(table(spark, d, "raw_calls").withColumn("whole", F.col("raw")), "raw", CALL_FIELDS, keep=["whole"])
    path = Scratch(spark, "records").path
    raw.where("whole is not null and (reason is null or reason <> 'quoting')").select("whole").write.text(path)
    rows = load_files(spark, path, CALL_FIELDS)
    return rows.select(*(F.col(f.name) for f in CALL_FIELDS), "reason", F.col("raw").alias("rejected"))


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_loaded": p4_loaded, "p4_files": p4_files}

_P1 = """
WITH g AS (
  SELECT seq_id, gene_id, strand, least("left", "right") AS a, greatest("left", "right") AS b FROM gtf
  WHERE (type IS NULL OR type NOT IN ('gene', 'transcript')) AND strand IN ('+', '-')
    AND seq_id IS NOT NULL AND gene_id IS NOT NULL AND "left" IS NOT NULL AND "right" IS NOT NULL),
m AS (SELECT *, max(b) OVER (PARTITION BY seq_id, gene_id, strand ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM g),
i AS (SELECT *, sum(CASE WHEN a <= top + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY seq_id, gene_id, strand ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isl FROM m),
p AS (SELECT seq_id, gene_id, strand, min(a) AS from_pos, max(b) AS to_pos FROM i GROUP BY seq_id, gene_id, strand, isl),
n AS (SELECT *, lag(to_pos) OVER (PARTITION BY seq_id, gene_id, strand ORDER BY from_pos) AS prev FROM p)
SELECT seq_id, gene_id, strand, 'period' AS kind, from_pos, to_pos FROM p
UNION ALL SELECT seq_id, gene_id, strand, 'gap', prev + 1, from_pos - 1 FROM n WHERE prev IS NOT NULL
"""

_P4 = r"""
WITH r AS (SELECT line_id, raw, regexp_full_match(raw, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') AS fine FROM raw_calls
           WHERE raw IS NULL OR NOT starts_with(raw, '#')),
f AS (SELECT line_id, raw, fine, CASE WHEN fine THEN regexp_extract_all(',' || raw, ',("(?:[^"]|"")*"|[^",]*)', 1) END AS c FROM r),
v AS (SELECT *, CASE WHEN raw IS NULL OR raw = '' THEN 0 ELSE len(c) END AS n,
  list_transform(c, lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:len(x) - 1], '""', '"') ELSE x END) AS u FROM f),
t AS (SELECT line_id, raw, fine, n, u, list_transform(u, lambda x: trim(x, ' ')) AS w FROM v),
z AS (SELECT *,
  CASE WHEN regexp_full_match(w[3], '[0-9]+') THEN TRY_CAST(w[3] AS BIGINT) END AS pos,
  CASE WHEN regexp_full_match(w[4], '[0-9]+') THEN TRY_CAST(w[4] AS BIGINT) END AS e,
  CASE WHEN regexp_full_match(w[5], '-?[0-9]+') THEN TRY_CAST(w[5] AS BIGINT) END AS l FROM t),
q AS (SELECT *, CASE WHEN raw IS NOT NULL AND NOT fine THEN 'quoting' WHEN n <> 8 THEN 'column_count'
  WHEN pos IS NULL OR pos < 1 THEN 'bad_pos' WHEN e IS NULL OR e < 1 OR e < pos THEN 'bad_end'
  WHEN l IS NULL AND w[5] NOT IN ('', '.', 'NA') THEN 'bad_len'
  WHEN w[6] NOT IN ('P', 'S', 'I', 'i') THEN 'bad_tp' END AS reason FROM z)
"""

SQL = {
    "p4_files": _P4
    + """SELECT CASE WHEN reason IS NULL THEN u[1] END AS id, CASE WHEN reason IS NULL THEN u[2] END AS chrom, CASE WHEN reason IS NULL THEN pos END AS pos, CASE WHEN reason IS NULL THEN e END AS "end",
      CASE WHEN reason IS NULL THEN l END AS len, CASE WHEN reason IS NULL THEN w[6] END AS tp, CASE WHEN reason IS NULL THEN u[7] END AS sample, CASE WHEN reason IS NULL THEN u[8] END AS note, reason,
      CASE WHEN reason IS NOT NULL THEN raw END AS rejected FROM q WHERE raw IS NOT NULL AND (reason IS NULL OR reason <> 'quoting')""",
    "p1_found": _P1,
    "p4_found": _P4 + "SELECT line_id, reason FROM q WHERE reason IS NOT NULL",
    "p4_loaded": _P4 + 'SELECT line_id, u[1] AS id, u[2] AS chrom, pos, e AS "end", l AS len, w[6] AS tp, u[7] AS sample, u[8] AS note FROM q WHERE reason IS NULL',
}
