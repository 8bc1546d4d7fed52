"""Continuous periods and gaps of overlapping closed intervals.

Positions are discretised to exact units (1 unit = 1 position). Every entity's axis is cut into
shards of ``shard_units`` units; the covered units of one entity in one shard form a run bitmap: a
sorted ``int32`` array (first, last, first, last, ...) of set runs, relative to the shard.

1. each input partition unions its own intervals into run bitmaps (before any shuffle);
2. the bitmaps of an (entity, shard) meet in one task and are unioned; set runs and clear runs
   inside the shard are final there, only the outermost runs are passed on;
3. the outermost runs, at most two per (entity, shard), are stitched across shard borders.

A hot entity is therefore spread over its shards, and what reaches one task for a shard is bounded
by the runs that fit into it, however many rows cover it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.runtime import Stored

SHARD_UNITS = 1 << 20
#: Rows a task holds before it unions them.
BUFFER_ROWS = 1 << 19


def _codes(tab: pa.Table, name: str) -> np.ndarray:
    """A number per row, equal for equal values: the key may be of any type that has a dictionary form."""
    return tab.column(name).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _segments(tab: pa.Table, names: list[str]) -> np.ndarray:
    """Dense segment number of each row of a table in which equal ``names`` lie together."""
    new = np.zeros(len(tab), dtype=bool)
    for name in names:
        codes = _codes(tab, name)
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new)


def _union(seg: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set runs of all segments at once: rows sorted by (seg, lo) -> (seg, first, last) of each run."""
    shift = seg * (width + 2)  # two unused units between segments, so that no run crosses
    top = np.maximum.accumulate(hi + shift)
    first = np.ones(len(lo), dtype=bool)
    first[1:] = (lo + shift)[1:] > top[:-1] + 1
    at = np.flatnonzero(first)
    ends = np.append(at[1:], len(lo)) - 1
    return seg[at], lo[at], top[ends] - shift[at]


def _bitmaps(seg: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(first row of each segment, one binary run bitmap per segment)."""
    at = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
    flat = np.empty(2 * len(lo), dtype="<i4")
    flat[0::2], flat[1::2] = lo, hi
    offsets = np.append(at, len(lo)).astype(np.int32) * 8
    return at, pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _encode(keys: list[str], width: int):
    by = [*keys, "shard"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            tab = pa.Table.from_batches(held)
            tab = tab.take(pa.array(np.lexsort((tab["lo"].to_numpy(), tab["shard"].to_numpy(), *(_codes(tab, k) for k in keys)))))
            seg, lo, hi = _union(_segments(tab, by), tab["lo"].to_numpy(), tab["hi"].to_numpy(), width)
            at, maps = _bitmaps(seg, lo, hi)
            firsts = tab.take(np.flatnonzero(np.diff(_segments(tab, by), prepend=-1)))
            return pa.RecordBatch.from_arrays([*(firsts[k].combine_chunks() for k in by), maps], names=[*by, "runs"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= BUFFER_ROWS:
                yield flush()
                held, rows = [], 0
        if held:
            yield flush()

    return run


def _joined(tab: pa.Table, by: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Union of the bitmaps of each key: (a table row of each key, then key number, first, last of each run)."""
    seg = _segments(tab, by)
    maps = tab["runs"].combine_chunks()
    offs = np.frombuffer(maps.buffers()[1], dtype=np.int32)[maps.offset : maps.offset + len(maps) + 1]
    flat = np.frombuffer(maps.buffers()[2], dtype="<i4")[offs[0] // 4 : offs[-1] // 4].astype(np.int64)
    seg_of = np.repeat(seg, np.diff(offs) // 8)
    lo, hi = flat[0::2], flat[1::2]
    order = np.lexsort((lo, seg_of))
    return np.flatnonzero(np.diff(seg, prepend=-1)), *_union(seg_of[order], lo[order], hi[order], width)


def _extract(keys: list[str], width: int):
    """Union the bitmaps of each (entity, shard); rows arrive sorted by it."""
    by = [*keys, "shard"]

    def compact(tab: pa.Table) -> pa.Table:
        """One bitmap for a key whose further bitmaps may follow: what is held stays as small as a shard."""
        head, seg, lo, hi = _joined(tab, by, width)
        _, maps = _bitmaps(seg, lo, hi)
        return pa.Table.from_arrays([*(tab[k].take(head) for k in by), maps], names=tab.column_names)

    def rows_of(tab: pa.Table) -> pa.RecordBatch:
        head, seg_r, lo, hi = _joined(tab, by, width)
        start = np.append(True, seg_r[1:] != seg_r[:-1])
        end = np.append(start[1:], True)
        shard = tab["shard"].to_numpy()[head][seg_r] * width
        inner = ~start & ~end
        gap_at = np.flatnonzero(~start)  # a clear run lies before every run but the first
        parts = [
            (head[seg_r[inner]], "period", shard[inner] + lo[inner], shard[inner] + hi[inner]),
            (head[seg_r[gap_at]], "gap", shard[gap_at] + hi[gap_at - 1] + 1, shard[gap_at] + lo[gap_at] - 1),
            (head[seg_r[~inner]], "edge", shard[~inner] + lo[~inner], shard[~inner] + hi[~inner]),
        ]
        rows = tab.select(by).take(np.concatenate([p[0] for p in parts]))
        kind = pa.array(np.repeat([p[1] for p in parts], [len(p[0]) for p in parts]), pa.string())
        cols = [rows[k].combine_chunks() for k in by]
        return pa.RecordBatch.from_arrays([*cols, kind, pa.array(np.concatenate([p[2] for p in parts])), pa.array(np.concatenate([p[3] for p in parts]))], names=[*by, "kind", "from_pos", "to_pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tab = pa.Table.from_batches([batch])
            tab = pa.concat_tables([held, tab]) if held is not None else tab
            seg = _segments(tab, by)
            whole = int(np.searchsorted(seg, seg[-1]))  # the last key may go on in the next batch
            if whole:
                yield rows_of(tab.slice(0, whole))
            held = compact(tab.slice(whole))
        if held is not None and len(held):
            yield rows_of(held)

    return run


def merge_periods(
    df: DataFrame,
    keys: list[str],
    lo: str | Column,
    hi: str | Column,
    shard_units: int = SHARD_UNITS,
) -> DataFrame:
    """Periods and gaps of closed intervals [lo, hi] per entity ``keys``.

    Result: the key columns and ``kind`` ('period' or 'gap'), ``from_pos``, ``to_pos`` (bigint, closed).
    Intervals that overlap, nest or touch (the next begins at most one unit after the end) form one
    period; a gap is a stretch between two consecutive periods of an entity.

    Keys may be of any atomic type. Defined cases: rows with a null in a key, lo or hi don't count; lo > hi is swapped; repeated rows
    change nothing; an empty input gives an empty result; other columns, whatever their names, are
    ignored. Positions may be negative. An interval costs one row per shard it touches, so choose
    ``shard_units`` (below 2^31) not far under the usual interval length.
    """
    lo_c, hi_c = (F.col(c) if isinstance(c, str) else c for c in (lo, hi))
    own = [f"k{i}" for i in range(len(keys))]
    base = df.select(*(F.col(k).alias(o) for k, o in zip(keys, own)), F.least(lo_c, hi_c).cast("bigint").alias("a"), F.greatest(lo_c, hi_c).cast("bigint").alias("b"), (lo_c.isNotNull() & hi_c.isNotNull()).alias("ok"))
    base = base.where("ok").dropna(subset=own)
    types = {f.name: f.dataType for f in base.schema.fields}
    key_ddl = ", ".join(f"{o} {types[o].simpleString()}" for o in own)
    width = F.lit(shard_units).cast("bigint")
    cells = base.withColumn("shard", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor(F.col("b") / width)))).select(
        *own,
        "shard",
        F.greatest(F.col("a") - F.col("shard") * width, F.lit(0)).cast("bigint").alias("lo"),
        F.least(F.col("b") - F.col("shard") * width, width - 1).cast("bigint").alias("hi"),
    )
    maps = cells.mapInArrow(_encode(own, shard_units), f"{key_ddl}, shard bigint, runs binary")
    maps = maps.repartition(*own, "shard").sortWithinPartitions(*own, "shard")
    runs = Stored(maps.mapInArrow(_extract(own, shard_units), f"{key_ddl}, shard bigint, kind string, from_pos bigint, to_pos bigint"), "periods").df

    axis = Window.partitionBy(*own).orderBy("from_pos")
    edges = (
        runs.where("kind = 'edge'")
        .withColumn("before", F.lag("to_pos").over(axis))
        .withColumn("same_shard", F.lag("shard").over(axis) == F.col("shard"))
        .withColumn("opens", F.when(F.col("from_pos") <= F.col("before") + 1, 0).otherwise(1))
        .withColumn("island", F.sum("opens").over(axis.rowsBetween(Window.unboundedPreceding, 0)))
    )
    # one aggregation gives the period and, with its first edge, the gap in front of it
    stitched = edges.groupBy(*own, "island").agg(
        F.min("from_pos").alias("from_pos"),
        F.max("to_pos").alias("to_pos"),
        F.min(F.when((F.col("opens") == 1) & ~F.col("same_shard"), F.col("before") + 1)).alias("gap_from"),
    )
    pair = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("from_pos"), F.col("to_pos")),
        F.struct(F.lit("gap").alias("kind"), F.col("gap_from").alias("from_pos"), (F.col("from_pos") - 1).alias("to_pos")),
    )
    stitched = stitched.select(*own, F.inline(F.filter(pair, lambda x: x["from_pos"].isNotNull())))
    done = runs.where("kind <> 'edge'").select(*own, "kind", "from_pos", "to_pos").unionByName(stitched)
    return done.select(*(F.col(o).alias(k) for k, o in zip(keys, own)), "kind", "from_pos", "to_pos")
