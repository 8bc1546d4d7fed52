"""Percentiles of very large columns by deterministic buffer collapsing.

A summary of one group is a set of sorted buffers of ``size`` values; a buffer of level l stands for
``size * 2**l`` values, each with weight 2**l. Values that don't fill a buffer wait, with weight 1, in
a short buffer of level 0. Two buffers of one level meet in a collapse: of their merged values every
second one stays, as a buffer of the next level. Raw values that are enough for 2**l buffers collapse
to level l in one go, by keeping the middle one of every 2**l sorted values.

A collapse into weight w moves the rank of any value by at most w / 2. Every summary carries the sum
of these errors, so each result states its own bound. Collapses form a binary tree by level, so the
bound of n values is at most n * log2(n / size) / (2 * size) ranks. Summaries merge in any order and
number: partitions, days and reruns combine by the same step. A task takes the buffers of a group in
the order of their levels and values, so the same summaries give the same result in every run.
Groups of fewer than ``size`` values are exact.

Stored form: one row per buffer (group columns, ``summary_level``, ``summary_buf`` array<double>,
``summary_err``); the last is the error gathered by the row's own summary, held on one of its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 4096
#: Values that a task holds before it turns them into buffers.
BUFFER_ROWS = 1 << 20
#: Summaries of one group that one task may merge in the first merging step.
FAN_IN = 64
INNER, OUTER = ("level", "buf", "err"), ("summary_level", "summary_buf", "summary_err")


class Summary:
    """Buffers of one group; see the module's text."""

    __slots__ = ("size", "short", "full", "err")

    def __init__(self, size: int):
        self.size = size
        self.short: list[np.ndarray] = []
        self.full: dict[int, np.ndarray] = {}
        self.err = 0.0

    def add_values(self, values: np.ndarray) -> None:
        self.short.append(values)
        if sum(map(len, self.short)) >= self.size:
            self._bulk()

    def _bulk(self) -> None:
        values = np.concatenate(self.short)
        rest = len(values) % self.size
        self.short = [values[len(values) - rest :]] if rest else []
        at, buffers = 0, (len(values) - rest) // self.size
        for level in reversed(range(buffers.bit_length())):
            if buffers >> level & 1:
                part = np.sort(values[at : at + (self.size << level)])
                at += self.size << level
                if level:
                    self.err += (1 << level) / 2
                self.add_buffer(level, part[((1 << level) - 1) // 2 :: 1 << level])

    def add_buffer(self, level: int, buf: np.ndarray) -> None:
        """A full sorted buffer; equal levels collapse upwards."""
        while (other := self.full.pop(level, None)) is not None:
            both = np.sort(np.concatenate([other, buf]), kind="stable")
            # of an even weight the lower and the upper middle take turns by level
            buf = both[level & 1 :: 2]
            level += 1
            self.err += (1 << level) / 2
        self.full[level] = buf

    def rows(self) -> list[tuple[int, np.ndarray]]:
        short = [(0, np.sort(np.concatenate(self.short)))] if self.short else []
        return short + sorted(self.full.items())

    def percentiles(self, qs: list[float]) -> tuple[int, list[float]]:
        """(number of values, for each q the value whose rank is nearest to ceil(q * n))."""
        parts = self.rows()
        values = np.concatenate([b for _, b in parts])
        weights = np.concatenate([np.full(len(b), 1 << lv) for lv, b in parts])
        order = np.argsort(values, kind="stable")
        values, upto = values[order], np.cumsum(weights[order])
        n = int(upto[-1])
        want = [min(n, max(1, math.ceil(round(q * n, 9)))) for q in qs]
        return n, [float(values[np.searchsorted(upto, w)]) for w in want]


def _names(keys: list[str]) -> list[str]:
    return [f"k{i}" for i in range(len(keys))]


def _starts(tab: pa.Table, own: list[str]) -> np.ndarray:
    new = np.zeros(len(tab), dtype=bool)
    new[:1] = True
    for k in own:
        col = tab[k].combine_chunks()
        codes = pc.fill_null(col.dictionary_encode(null_encoding="encode").indices, -1).to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _emit(heads: pa.Table, own: list[str], rows: list[list[tuple[int, np.ndarray]]], errs: list[float]) -> pa.RecordBatch:
    take = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = [b for r in rows for _, b in r]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in flat]))).astype(np.int32)
    buf = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat)))
    err = np.zeros(len(flat))
    err[np.flatnonzero(np.diff(take, prepend=-1))] = errs
    picked = heads.take(take)
    return pa.RecordBatch.from_arrays([*(picked[k].combine_chunks() for k in own), pa.array([lv for r in rows for lv, _ in r], pa.int32()), buf, pa.array(err)], names=[*own, "level", "buf", "err"])


def _build(own: list[str], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def flush() -> pa.RecordBatch:
            tab = pa.Table.from_batches(held)
            tab = tab.take(pc.sort_indices(tab, [(k, "ascending") for k in own])) if own else tab
            at = _starts(tab, own)
            values = tab["v"].to_numpy()
            rows, errs = [], []
            for a, b in zip(at, np.append(at[1:], len(values))):
                if b - a < size:
                    rows.append([(0, np.sort(values[a:b]))])
                    errs.append(0.0)
                else:
                    s = Summary(size)
                    s.add_values(values[a:b])
                    rows.append(s.rows())
                    errs.append(s.err)
            return _emit(tab.select(own or ["v"]).take(at), own, rows, errs)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= BUFFER_ROWS:
                yield flush()
                held, count = [], 0
        if held:
            yield flush()

    return run


def _merged(own: list[str], size: int, finish) -> object:
    """Merge the summaries of each group; rows arrive sorted by group. finish(heads, summaries) -> batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key: tuple | None = None
        head: pa.Table | None = None
        now: Summary | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tab = pa.Table.from_batches([batch])
            at = _starts(tab, own)
            lists = tab["buf"].combine_chunks()
            flat = lists.flatten().to_numpy()
            offs = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            level, err = tab["level"].to_numpy(), tab["err"].to_numpy()
            firsts = tab.select(own).take(at) if own else None
            keys = list(zip(*(firsts[k].to_pylist() for k in own))) if own else [()]
            heads, ready = [], []
            for i, (a, b) in enumerate(zip(at, np.append(at[1:], len(tab)))):
                if open_key != keys[i] or now is None:
                    if now is not None:
                        heads.append(head)
                        ready.append(now)
                    open_key, now = keys[i], Summary(size)
                    head = firsts.slice(i, 1) if own else None
                now.err += float(err[a:b].sum())
                short = []
                for r in range(a, b):
                    buf = flat[offs[r] : offs[r + 1]]
                    if level[r] == 0 and len(buf) < size:
                        short.append(buf)
                    else:
                        now.add_buffer(int(level[r]), buf)
                if short:
                    now.add_values(np.concatenate(short))
            if ready:
                yield finish(heads, ready)
        if now is not None:
            yield finish([head], [now])

    return run


def _ddl(df: DataFrame, own: list[str]) -> str:
    types = dict(df.dtypes)
    return "".join(f"{o} {types[o]}, " for o in own)


def summarise(df: DataFrame, keys: list[str], value: str, size: int = SIZE, null_keys: tuple[str, ...] = ()) -> DataFrame:
    """Summaries per group ``keys`` of the numeric column ``value``, merged once per partition only.

    Rows where a key or the value is null, or the value is NaN, don't count; but a null in a key that
    is one of ``null_keys`` is a group of its own. Key columns keep their names. An empty input gives
    no rows.
    """
    own = _names(keys)
    base = df.select(*(F.col(k).alias(o) for k, o in zip(keys, own)), F.col(value).cast("double").alias("v"))
    base = base.dropna(subset=[*(o for k, o in zip(keys, own) if k not in null_keys), "v"])
    built = base.mapInArrow(_build(own, size), f"{_ddl(base, own)}level int, buf array<double>, err double")
    return built.select(*(F.col(o).alias(k) for o, k in zip(own, keys)), *(F.col(i).alias(o) for i, o in zip(INNER, OUTER)))


def combine(summaries: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """One summary per group ``keys`` of many, from other partitions, days or runs.

    ``keys`` may be fewer than the summaries were made for. A group's summaries first meet in as many
    tasks as ``FAN_IN`` asks for, by the partition they come from, then once more; a task only ever
    holds one summary of bounded size.
    """
    own = _names(keys)
    rows = summaries.select(*(F.col(k).alias(o) for k, o in zip(keys, own)), *(F.col(o).alias(i) for i, o in zip(INNER, OUTER)))
    schema = f"{_ddl(rows, own)}level int, buf array<double>, err double"

    def keep(heads: list[pa.Table], ready: list[Summary]) -> pa.RecordBatch:
        first = pa.concat_tables(heads) if own else pa.table({"x": [0]})
        return _emit(first, own, [s.rows() for s in ready], [s.err for s in ready])

    salted = rows.withColumn("salt", F.spark_partition_id() % F.lit(FAN_IN))
    first = salted.repartition(*own, "salt").sortWithinPartitions(*own, "salt", "level", "buf").drop("salt")
    return first.mapInArrow(_merged(own, size, keep), schema).select(*(F.col(o).alias(k) for o, k in zip(own, keys)), *(F.col(i).alias(o) for i, o in zip(INNER, OUTER)))


def percentiles(summaries: DataFrame, keys: list[str], qs: dict[str, float], size: int = SIZE) -> DataFrame:
    """Per group: ``n`` (bigint), a column per entry of ``qs`` (double), ``rank_error`` (double).

    One of the ranks that the value of quantile q takes among all rows of the group is within
    ``rank_error`` of ceil(q * n); 0 means exact.
    """
    own = _names(keys)
    names, fractions = list(qs), list(qs.values())
    rows = summaries.select(*(F.col(k).alias(o) for k, o in zip(keys, own)), *(F.col(o).alias(i) for i, o in zip(INNER, OUTER)))
    schema = f"{_ddl(rows, own)}n bigint, {''.join(f'`{q}` double, ' for q in names)}rank_error double"

    def finish(heads: list[pa.Table], ready: list[Summary]) -> pa.RecordBatch:
        first = pa.concat_tables(heads) if own else None
        found = [s.percentiles(fractions) for s in ready]
        cols = [*(first[k].combine_chunks() for k in own)]
        cols += [pa.array([n for n, _ in found], pa.int64())]
        cols += [pa.array([v[i] for _, v in found], pa.float64()) for i in range(len(names))]
        cols += [pa.array([s.err for s in ready], pa.float64())]
        return pa.RecordBatch.from_arrays(cols, names=[*own, "n", *names, "rank_error"])

    near = rows.repartition(*own) if own else rows.coalesce(1)
    done = near.sortWithinPartitions(*own, "level", "buf")
    return done.mapInArrow(_merged(own, size, finish), schema).select(*(F.col(o).alias(k) for o, k in zip(own, keys)), "n", *names, "rank_error")
