"""Structured Streaming forms of the windowed operators; they work on batch tables as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_trigger: int = 1) -> DataFrame:
    """A stream of files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(fmt).load(path)


def _late(df: DataFrame, ts: str, late: str) -> DataFrame:
    return df.withWatermark(ts, late) if df.isStreaming else df


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], aggs: list, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Aggregates per event-time window: win_start, win_end, keys, aggregates."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    g = _late(df, ts, late).groupBy(w.alias("w"), *keys).agg(*aggs)
    return g.select(F.col("w.start").alias("win_start"), F.col("w.end").alias("win_end"), *keys, *[c for c in g.columns if c not in ("w", *keys)])


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], aggs: list, late: str = "1 hour") -> DataFrame:
    """Aggregates per run of events at most ``gap`` apart; session_end is the last event plus the gap."""
    g = _late(df, ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*aggs)
    return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, *[c for c in g.columns if c not in ("w", *keys)])


def first_seen(df: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """One row per key within the watermark; on a batch table the earliest row counts."""
    if df.isStreaming:
        return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
    w = F.row_number().over(Window.partitionBy(*keys).orderBy(ts))
    return df.withColumn("__rn", w).where("__rn = 1").drop("__rn")


def to_memory(df: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.format("memory").queryName(name).outputMode(mode).start()


def to_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once files, all available input then stop."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
