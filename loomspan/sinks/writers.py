"""Writers: delimited text, intervals, wide matrices, annotated variants, sequences, checksums."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tsv(df: DataFrame, path: str, columns: list[str] | None = None, compression: str | None = None, mode: str = "errorifexists") -> None:
    """Ordered columns with a header; other columns are left out. Publication is atomic: readers see
    the files when the commit protocol has renamed them."""
    out = df.select(*(columns or df.columns)).write.mode(mode).option("sep", "\t").option("header", True)
    (out.option("compression", compression) if compression else out).csv(path)


def render_null(df: DataFrame, mark: str = "NA") -> DataFrame:
    """All columns as text, nulls as a mark."""
    return df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(mark)).alias(c) for c in df.columns))


def wide(df: DataFrame, path: str, row: str, col: str, value: str, cols: list[str], digits: int = 6, mode: str = "errorifexists") -> None:
    """Long to wide with zero fill and fixed digits."""
    m = df.groupBy(row).pivot(col, cols).agg(F.first(value)).na.fill(0.0)
    tsv(m.select(row, *(F.format_string(f"%.{digits}f", F.col(f"`{c}`").cast("double")).alias(c) for c in cols)), path, mode=mode)


def bed(df: DataFrame, path: str, chrom: str, start: str, end: str, name: Column | None = None, closed: bool = False, mode: str = "errorifexists") -> None:
    """Half-open intervals without a header; closed 1-based coordinates are converted."""
    cols = [F.col(chrom), (F.col(start) - (1 if closed else 0)).alias("start"), F.col(end).alias("end")] + ([name.alias("name")] if name is not None else [])
    df.select(*cols).write.mode(mode).option("sep", "\t").csv(path)


def vcf_lines(df: DataFrame, extra: dict[str, Column], new_id: Column | None = None) -> DataFrame:
    """Text lines of variant rows (chrom, pos, id, ref, alt, qual, filt, info text, format, samples), with
    a rewritten id and appended info keys; null values add nothing."""
    add = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in extra.items()]
    info = F.concat_ws(";", F.when(~F.col("info").isin("", "."), F.col("info")), *add)
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return df.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), (new_id if new_id is not None else F.col("id")), dot("ref"), dot("alt"), dot("qual"), dot("filt"), F.when(info == "", ".").otherwise(info), "format", F.array_join("samples", "\t")).alias("value"))


def fasta_lines(df: DataFrame, name: str, seq: str, width: int = 60) -> DataFrame:
    body = F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")
    return df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), body).alias("value"))


def text(df: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = None) -> None:
    w = df.select("value").write.mode(mode)
    (w.option("compression", compression) if compression else w).text(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """sha256 and size of every file; each file is hashed by one task."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def versioned(path: str) -> str:
    """A dated path beside an existing output, so that nothing is overwritten."""
    return f"{path.rstrip('/')}/v{time.strftime('%Y%m%dT%H%M%S')}"


def spreadsheet(df: DataFrame, path: str, most: int = 1_000_000) -> None:
    """A workbook from the driver; a sheet holds at most ``most`` rows, more are refused."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError("too many rows for a sheet")
    rows.to_excel(path, index=False)
