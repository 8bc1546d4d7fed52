"""Coverage accounting along an axis: depth, exclusive base pairs by priority, painting."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.islands import SHARD, shard_cells


def _events(df: DataFrame, keys: list[str], cls: str, start: str, end: str) -> DataFrame:
    """(keys, pos, cls, delta): +1 where an interval opens, -1 where it closes, summed per position."""
    known = df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) < F.col(end)))
    both = known.select(*keys, F.col(cls).alias("cls"), F.inline(F.array(F.struct(F.col(start).alias("pos"), F.lit(1).alias("d")), F.struct(F.col(end).alias("pos"), F.lit(-1).alias("d")))))
    return both.groupBy(*keys, "pos", "cls").agg(F.sum("d").alias("d"))


def _depths(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    ev = _events(df.withColumn("__one", F.lit(1)), keys, "__one", start, end)
    w = Window.partitionBy(*keys).orderBy("pos")
    seg = ev.withColumns({"depth": F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), "seg_end": F.lead("pos").over(w)})
    return seg.where("depth > 0 and seg_end is not null").select(*keys, F.col("pos").alias("seg_start"), "seg_end", "depth")


def _owners(df: DataFrame, keys: list[str], cls: str, start: str, end: str, priority: list[str]) -> DataFrame:
    ev = _events(df.where(F.col(cls).isin(priority)), keys, cls, start, end)
    at = ev.groupBy(*keys, "pos").agg(*(F.sum(F.when(F.col("cls") == c, F.col("d")).otherwise(0)).alias(f"__d{i}") for i, c in enumerate(priority)))
    w = Window.partitionBy(*keys).orderBy("pos")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    owner = F.lit(None).cast("string")
    for i, c in reversed(list(enumerate(priority))):
        owner = F.when(F.sum(f"__d{i}").over(run) > 0, F.lit(c)).otherwise(owner)
    seg = at.withColumns({"owner": owner, "seg_end": F.lead("pos").over(w)})
    return seg.where("owner is not null and seg_end is not null").select(*keys, F.col("pos").alias("seg_start"), "seg_end", "owner")


def _stitched(seg: DataFrame, df: DataFrame, keys: list[str], value: str, start: str, end: str) -> DataFrame:
    """Segments of shards, those that only a shard's border cuts put together again.

    Only segments that touch a border, at most two a shard, pass a window over a whole key. An interval
    of ``df`` that begins or ends on a border makes it a real cut.
    """
    real = df.where(F.col(start) < F.col(end)).select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.explode(F.array(F.col(start).cast("bigint"), F.col(end).cast("bigint"))).alias("__pos")).where(F.col("__pos") % SHARD == 0).distinct()
    border = (F.col("seg_start") % SHARD == 0) | (F.col("seg_end") % SHARD == 0)
    on = F.col("seg_start") == F.col("__pos")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    w = Window.partitionBy(*keys).orderBy("seg_start")
    edge = seg.where(border).join(real, on, "left")
    opens = (F.col("seg_start") % SHARD != 0) | F.col("__pos").isNotNull() | ~F.lag("seg_end").over(w).eqNullSafe(F.col("seg_start"))
    edge = edge.withColumn("__n", F.when(opens, 1).otherwise(0)).withColumn("__n", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.groupBy(*keys, "__n").agg(F.min("seg_start").alias("seg_start"), F.max("seg_end").alias("seg_end"), F.first(value).alias(value))
    cols = [*keys, "seg_start", "seg_end", value]
    return seg.where(~border).select(*cols).unionByName(edge.select(*cols))


def depth_segments(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Stretches of constant depth above 0: keys, seg_start, seg_end, depth (half-open), swept shard by shard."""
    known = df.where(F.col(start) < F.col(end))
    cells = shard_cells(known, keys, start, end)
    return _stitched(_depths(cells, [*keys, "__shard"], "__lo", "__hi"), known, keys, "depth", start, end)


def priority_segments(df: DataFrame, keys: list[str], cls: str, start: str, end: str, priority: list[str]) -> DataFrame:
    """Elementary segments, each owned by the first class of ``priority`` that covers it: keys,
    seg_start, seg_end, owner. Classes not listed don't count; the list is short (one sum a class).
    Swept shard by shard."""
    known = df.where((F.col(start) < F.col(end)) & F.col(cls).isin(priority))
    cells = shard_cells(known, keys, start, end, keep=[cls])
    return _stitched(_owners(cells, [*keys, "__shard"], cls, "__lo", "__hi", priority), known, keys, "owner", start, end)


def priority_bp(df: DataFrame, keys: list[str], cls: str, start: str, end: str, priority: list[str]) -> DataFrame:
    """Exclusive base pairs per keys and owning class, swept shard by shard, so that a hot key is spread."""
    cells = shard_cells(df, keys, start, end, keep=[cls]).withColumnsRenamed({"__lo": start, "__hi": end})
    return _owners(cells, [*keys, "__shard"], cls, start, end, priority).groupBy(*keys, "owner").agg(F.sum(F.col("seg_end") - F.col("seg_start")).alias("bp"))


def paint(df: DataFrame, regions: DataFrame, region: str, rstart: str, rend: str, start: str, end: str, cls: str, order: list[str], rest: str = "Others") -> DataFrame:
    """First writer wins: every position of a region belongs to the first interval, in ``order``, that
    covers it, unpainted ones to ``rest``. Result: region, cls, bp. Intervals of one order go by class.

    Regions are cut into shards; of intervals that cover the same part of a shard only the first can
    own it, so only that one goes on. A sweep over the sorted parts of a shard keeps the open ones in a
    heap; a part is pushed and popped once. ``df`` carries the region's name.
    """
    bounds = regions.select(F.col(region).alias("__r"), F.col(rstart).cast("bigint").alias("__a"), F.col(rend).cast("bigint").alias("__b")).where("__a < __b")
    clip = df.join(bounds, F.col(region) == F.col("__r")).select("__r", F.greatest(F.col(start), F.col("__a")).cast("bigint").alias("__s"), F.least(F.col(end), F.col("__b")).cast("bigint").alias("__e"), F.struct(*(F.col(o).alias(f"o{i}") for i, o in enumerate(order)), F.col(cls).alias("c")).alias("__k")).where("__s < __e")
    cells = shard_cells(clip, ["__r"], "__s", "__e", keep=["__k"]).groupBy("__r", "__shard", "__lo", "__hi").agg(F.min("__k").alias("__k"))
    rank = F.row_number().over(Window.partitionBy("__r", "__shard").orderBy("__k"))
    cells = cells.select("__r", "__shard", "__lo", "__hi", rank.alias("__rank"), F.col("__k.c").alias("__c")).repartition("__r", "__shard").sortWithinPartitions("__r", "__shard", "__lo")

    def sweep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, heap, at, bp = None, [], 0, {}

        def until(pos: float) -> None:
            """Give the stretch up to ``pos`` to its owners."""
            nonlocal at
            while heap and at < pos:
                rank, hi, c = heap[0]
                if hi <= at:
                    heapq.heappop(heap)
                    continue
                to = min(hi, pos)
                bp[c] = bp.get(c, 0) + to - at
                at = to

        def rows() -> pd.DataFrame:
            until(float("inf"))
            heap.clear()
            return pd.DataFrame({"r": [key[0]] * len(bp), "c": list(bp), "bp": [int(v) for v in bp.values()]})

        for part in parts:
            done = []
            for r, shard, lo, hi, rank, c in zip(*(part[x].tolist() for x in part.columns)):
                if (r, shard) != key:
                    if key is not None:
                        done.append(rows())
                    key, at, bp = (r, shard), lo, {}
                until(lo)
                at = max(at, lo)
                heapq.heappush(heap, (rank, hi, c))
            if done:
                yield pd.concat(done)
        if key is not None:
            yield rows()

    types = dict(cells.dtypes)
    owned = cells.mapInPandas(sweep, f"r {types['__r']}, c {types['__c']}, bp bigint").groupBy("r", "c").agg(F.sum("bp").alias("bp"))
    whole = bounds.groupBy("__r").agg(F.sum(F.col("__b") - F.col("__a")).alias("__w"))
    painted = owned.groupBy("r").agg(F.sum("bp").alias("__p"))
    left = whole.join(painted, F.col("__r") == F.col("r"), "left").select(F.col("__r").alias("r"), F.lit(rest).alias("c"), (F.col("__w") - F.coalesce("__p", F.lit(0))).alias("bp")).where("bp > 0")
    return owned.unionByName(left).groupBy(F.col("r").alias(region), F.coalesce("c", F.lit(rest)).alias(cls)).agg(F.sum("bp").alias("bp"))


def dominant_class(df: DataFrame, keys: list[str], cls: str, bp: str, order: list[str]) -> DataFrame:
    """The class with the most bp; ties by the fixed ``order``."""
    rank = F.coalesce(F.expr(f"nullif(array_position(array({', '.join(repr(o) for o in order)}), {cls}), 0)"), F.lit(999))
    w = Window.partitionBy(*keys).orderBy(F.desc(bp), rank, cls)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
