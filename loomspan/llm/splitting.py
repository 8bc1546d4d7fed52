"""Splitting oversized items at natural boundaries by dynamic programming.

An item covers the half-open stretch [start, end). Pieces are at most ``max_len`` long and each later
piece starts ``overlap`` before the end of the one in front of it; the end of a piece that isn't the
last is a cut. A dynamic programme over the natural boundaries, in order of position, finds the
division with the least cost: first the number of forced cuts (cuts at no natural boundary), then the
sum of squared deviations of piece lengths from the even length.

Forced cuts need no candidates of their own. With step = max_len - overlap, and the item's start
taken as a cut at start + overlap, a stretch of length d between two neighbouring chosen boundaries
needs ceil(d / step) - 1 forced cuts, and spacing them evenly is best. Using one more natural boundary
inside a stretch never needs more forced cuts, as ceil(x) + ceil(y) - 2 <= ceil(x + y) - 1; so the
least number K of forced cuts up to a boundary is the sum over all boundaries in front of it, and two
boundaries a < b may follow each other in a cheapest division exactly if b - a is at most
(K(b) - K(a) + 1) * step. With g(x) = x - K(x) * step, which never falls, that is g(a) >= g(b) - step:
a sliding window over the boundaries, the same for natural and forced stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.skew import heavy_values, spread_lookup
from loomspan.runtime import shuffle_partitions

#: Width of the bins in which items meet boundaries.
BIN = 1_000_000


def divide(start: int, end: int, natural: np.ndarray, max_len: int, overlap: int) -> tuple[list[int], list[bool]]:
    """Cuts of [start, end) and, for each, whether it is natural. Needs 0 <= overlap < max_len."""
    if end - start <= max_len:
        return [], []
    step, first = max_len - overlap, start + overlap
    natural = np.unique(np.asarray(natural, dtype=np.int64))
    # a cut at start + overlap or before lets nothing begin later than the item itself
    at = np.concatenate([[first], natural[(natural > first) & (natural < end)], [end]]).astype(np.int64)
    forced = np.concatenate([[0], np.cumsum(-(-np.diff(at) // step) - 1)])
    reach = at - forced * step
    low = np.searchsorted(reach, reach - step)
    total_len = end - first
    even = total_len / -(-total_len // step)  # of a piece less its overlap
    cost = np.full(len(at), np.inf)
    cost[0] = 0.0
    prev = np.full(len(at), -1)
    for j in range(1, len(at)):
        a = slice(low[j], j)
        parts = forced[j] - forced[a] + 1
        each, more = np.divmod(at[j] - at[a], parts)
        uneven = (parts - more) * ((each - even) / max_len) ** 2 + more * ((each + 1 - even) / max_len) ** 2
        t = cost[a] + uneven
        k = int(t.argmin())
        cost[j], prev[j] = t[k], low[j] + k
    path, j = [], len(at) - 1
    while j >= 0:
        path.append(j)
        j = int(prev[j])
    path.reverse()
    cuts: list[int] = []
    kinds: list[bool] = []
    for a, b in zip(path, path[1:]):
        parts = int(forced[b] - forced[a]) + 1
        each, more = divmod(int(at[b] - at[a]), parts)
        inside = [int(at[a]) + i * each + min(i, more) for i in range(1, parts)]
        cuts += inside
        kinds += [False] * len(inside)
        if b < len(at) - 1:
            cuts.append(int(at[b]))
            kinds.append(True)
    return cuts, kinds


def split_items(
    items: DataFrame,
    boundaries: DataFrame,
    item: str,
    axis: str,
    start: str | Column,
    end: str | Column,
    at_axis: str,
    at: str,
    max_len: int = 1_000_000,
    overlap: int = 20_000,
) -> DataFrame:
    """Pieces of every distinct ``item`` that is longer than ``max_len``.

    Result: ``item``, ``axis`` (under their names), ``piece`` (from 1), ``piece_start``, ``piece_end``
    (half-open) and ``cut``: 'natural' or 'forced' for the end of a piece, null for the last piece.

    Natural boundaries are the positions ``at`` of ``boundaries`` with the item's axis, strictly inside
    it. Defined cases: items with a null id, start or end don't count; reversed ones are swapped; of
    an id listed several times the row with the least (axis, start, end) counts, nulls of axis last;
    an item with a null axis has no natural boundaries; repeated boundaries count once; empty tables
    give no rows, or forced cuts only.

    Items and boundaries meet by (axis, bin); the boundaries of a bin are first gathered to one short
    distinct array, so an axis or bin with many items adds one small row to each item; bins with many
    items are looked up by a broadcast of theirs alone, and the items stay spread (``spread_lookup``).
    One task holds the boundaries of one item only.
    """
    s, e = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    picked = (
        items.select(F.col(item).alias("item"), F.col(axis).alias("axis"), F.least(s, e).cast("bigint").alias("a"), F.greatest(s, e).cast("bigint").alias("b"), (s.isNotNull() & e.isNotNull()).alias("ok"))
        .where(F.col("ok") & F.col("item").isNotNull() & (F.col("b") - F.col("a") > max_len))
        .groupBy("item")
        .agg(F.min(F.struct(F.col("axis").isNull().alias("none"), F.col("axis"), F.col("a"), F.col("b"))).alias("r"))
        .select("item", "r.axis", "r.a", "r.b")
    )
    cell = F.concat_ws(":", F.col("axis").cast("string"), F.col("bin").cast("string"))
    cells = picked.withColumn("bin", F.explode(F.sequence(F.floor(F.col("a") / BIN), F.floor(F.col("b") / BIN)))).withColumn("cell", F.when(F.col("axis").isNotNull(), cell))
    marks = (
        boundaries.select(F.col(at_axis).alias("axis"), F.col(at).cast("bigint").alias("at"))
        .dropna()
        .withColumn("bin", F.floor(F.col("at") / BIN))
        .groupBy(cell.alias("cell"))
        .agg(F.collect_set("at").alias("marks"))
    )
    grouped = (
        spread_lookup(cells, "cell", marks, "cell", "marks", "marks", heavy_values(cells, "cell")["cell"], F.xxhash64("item"))
        .withColumn("marks", F.filter("marks", lambda x: (x > F.col("a")) & (x < F.col("b"))))
        .repartition(shuffle_partitions(items.sparkSession), "item")  # few bytes, much work: not to be coalesced
        .groupBy("item")
        .agg(F.first("axis", ignorenulls=True).alias("axis"), F.first("a").alias("a"), F.first("b").alias("b"), F.flatten(F.collect_list("marks")).alias("marks"))
    )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out: dict[str, list] = {k: [] for k in ("item", "axis", "piece", "piece_start", "piece_end", "cut")}
            for name, ax, a, b, marks in zip(part["item"], part["axis"], part["a"].tolist(), part["b"].tolist(), part["marks"]):
                cuts, kinds = divide(a, b, np.asarray(marks, dtype=np.int64), max_len, overlap)
                k = len(cuts) + 1
                out["item"] += [name] * k
                out["axis"] += [ax] * k
                out["piece"] += range(1, k + 1)
                out["piece_start"] += [a, *(c - overlap for c in cuts)]
                out["piece_end"] += [*cuts, b]
                out["cut"] += [*("natural" if x else "forced" for x in kinds), None]
            yield pd.DataFrame(out)

    types = dict(grouped.dtypes)
    ddl = f"item {types['item']}, axis {types['axis']}, piece int, piece_start bigint, piece_end bigint, cut string"
    return grouped.mapInPandas(run, ddl).withColumnsRenamed({"item": item, "axis": axis})
