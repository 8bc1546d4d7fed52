"""Divisions: every rule of a piece holds, and natural cuts are used whenever they suffice."""

import random

import numpy as np
import pytest

from loomspan.llm.splitting import divide, split_items


def natural_possible(start, end, marks, max_len, overlap):
    """Reachability by plain search."""
    marks = sorted({m for m in marks if start + max(overlap, 1) <= m < end})
    reach = {m for m in marks if m - start <= max_len}
    todo = list(reach)
    while todo:
        at = todo.pop()
        for m in marks:
            if m > at and m - (at - overlap) <= max_len and m not in reach:
                reach.add(m)
                todo.append(m)
    return any(end - (m - overlap) <= max_len for m in reach)


def check(start, end, marks, max_len, overlap):
    cuts, natural = divide(start, end, np.array(marks, dtype=np.int64), max_len, overlap)
    if end - start <= max_len:
        assert cuts == []
        return
    assert cuts == sorted(set(cuts)) and all(start < c < end for c in cuts)
    begins, ends = [start, *(c - overlap for c in cuts)], [*cuts, end]
    assert all(start <= b < e <= end and e - b <= max_len for b, e in zip(begins, ends))
    assert all((c in set(marks)) or not n for c, n in zip(cuts, natural))
    assert all(natural) == natural_possible(start, end, marks, max_len, overlap)


def least_forced(start, end, marks, max_len, overlap):
    """(forced cuts, sum of squared deviations) of the best division, over cuts at every position."""
    step, marks = max_len - overlap, set(marks)
    pieces = -(-(end - start - overlap) // step)
    even = (end - start - overlap) / pieces + overlap
    best = {}
    for c in range(start + max(overlap, 1), end):
        own = 0 if c in marks else 1
        options = [(0, (c - start - even) ** 2)] if c - start <= max_len else []
        options += [(f, q + (c - b + overlap - even) ** 2) for b in range(max(c - step, start), c) if b in best for f, q in [best[b]]]
        if options:
            f, q = min(options)
            best[c] = f + own, q
    return min((f, q + (end - c + overlap - even) ** 2) for c, (f, q) in best.items() if end - c <= step)


def test_least_forced_cuts_and_unevenness():
    rng = random.Random(7)
    for i in range(4000):
        max_len = rng.choice([6, 14, 30])
        overlap = rng.choice([0, 1, 3, max_len // 4])
        start = rng.randint(-20, 50)
        end = start + rng.randint(max_len + 1, max_len * 12)
        marks = [rng.randint(start - 5, end + 5) for _ in range(rng.choice([0, 2, 4, 10, 25]))]
        cuts, natural = divide(start, end, np.array(marks, dtype=np.int64), max_len, overlap)
        check(start, end, marks, max_len, overlap)
        pieces = -(-(end - start - overlap) // (max_len - overlap))
        even = (end - start - overlap) / pieces + overlap
        begins, ends = [start, *(c - overlap for c in cuts)], [*cuts, end]
        forced, uneven = least_forced(start, end, marks, max_len, overlap)
        assert sum(c not in set(marks) for c in cuts) == forced, (start, end, marks, max_len, overlap)
        assert abs(sum((e - b - even) ** 2 for b, e in zip(begins, ends)) - uneven) < 1e-6


def test_long_forced_stretch():
    marks = np.array([36, 37, 38, 142])
    cuts, natural = divide(0, 160, marks, 14, 1)
    assert natural.count(False) == 10 and len(cuts) == len(natural)


def test_random_items():
    rng = random.Random(4)
    for _ in range(1500):
        max_len = rng.choice([10, 50, 100])
        overlap = rng.choice([0, 1, 3, max_len // 4])
        start = rng.randint(-20, 1000)
        end = start + rng.randint(1, max_len * 6)
        marks = [rng.randint(start - 10, end + 10) for _ in range(rng.choice([0, 2, 10, 40]))]
        check(start, end, marks, max_len, overlap)


def test_borders():
    check(0, 1_000_000, [], 1_000_000, 20_000)
    check(0, 1_000_001, [], 1_000_000, 20_000)
    check(0, 1_980_000, [1_000_000], 1_000_000, 20_000)
    assert divide(0, 1_980_000, np.array([1_000_000]), 1_000_000, 20_000) == ([1_000_000], [True])
    assert divide(0, 1_980_001, np.array([1_000_000]), 1_000_000, 20_000)[1] != [True]
    # a cut closer to the start than the overlap would let a piece begin before the item
    assert not all(divide(0, 1_010_000, np.array([19_999]), 1_000_000, 20_000)[1])
    assert all(divide(0, 1_000_000 - 20_000 + 20_000 + 1, np.array([20_000, 30_000]), 1_000_000, 20_000)[1])
    check(0, 10**9, list(range(0, 10**9, 999_983)), 1_000_000, 20_000)


def test_evenness():
    cuts, _ = divide(0, 1_500, np.array([400, 760, 1000]), 1000, 20)
    assert cuts == [760]


@pytest.fixture
def gaps(spark):
    return spark.createDataFrame([("c", 90, 5), ("c", 90, 6), ("c", 40, 9), ("d", 50, 1), (None, 80, 1), ("c", None, 1)], "chrom string, start bigint, item int")


def test_frame(spark, gaps):
    items = spark.createDataFrame(
        [("long", "c", 0, 150, "x"), ("long", "c", 0, 150, "x"), ("back", "c", 150, 0, "x"), ("short", "c", 0, 100, "x"), ("nochrom", None, 0, 150, "x"), ("nogap", "e", 0, 150, "x"), (None, "c", 0, 150, "x"), ("nul", "c", None, 150, "x")],
        "id string, chrom string, start bigint, end bigint, piece string",
    )
    got = split_items(items, gaps, "id", "chrom", "start", "end", "chrom", "start", 100, 10).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append((r["piece"], r["piece_start"], r["piece_end"], r["cut"]))
    assert set(by) == {"long", "back", "nochrom", "nogap"}
    assert sorted(by["long"]) == sorted(by["back"]) == [(1, 0, 90, "natural"), (2, 80, 150, None)]
    assert [c for *_, c in sorted(by["nochrom"])] == ["forced", None] and [c for *_, c in sorted(by["nogap"])] == ["forced", None]


def test_empty(spark, gaps):
    none = spark.createDataFrame([], "id string, chrom string, start bigint, end bigint")
    assert split_items(none, gaps, "id", "chrom", "start", "end", "chrom", "start").count() == 0
    one = spark.createDataFrame([("a", "c", 0, 150)], "id string, chrom string, start bigint, end bigint")
    assert split_items(one, gaps.limit(0), "id", "chrom", "start", "end", "chrom", "start", 100, 10).where("cut = 'forced'").count() == 1


def test_many_items_on_one_stretch(spark, gaps):
    """2,000 items in one bin: each gets the bin's boundaries, in any number of partitions."""
    items = spark.range(2000).selectExpr("concat('i', id) as id", "'c' as chrom", "0 as start", "150 + id % 7 as end")
    got = split_items(items, gaps, "id", "chrom", "start", "end", "chrom", "start", 100, 10).where("cut is not null")
    assert got.groupBy("cut").count().collect()[0].asDict() == {"cut": "natural", "count": 2000}
