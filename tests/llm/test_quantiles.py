"""Percentiles against sorted values: the stated bound holds, and small groups are exact."""

import math

import numpy as np
import pytest

from loomspan.llm.quantiles import Summary, combine, percentiles, summarise

QS = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p99": 0.99}


def distance(values, answer, q):
    """How many ranks the answer's ranks are away from ceil(q n)."""
    values = np.sort(values)
    want = min(len(values), max(1, math.ceil(round(q * len(values), 9))))
    lo, hi = np.searchsorted(values, answer, "left") + 1, np.searchsorted(values, answer, "right")
    assert hi >= lo, "the answer is one of the values"
    return max(0, lo - want, want - hi)


@pytest.mark.parametrize("kind", ["random", "sorted", "reversed", "ties", "tails"])
@pytest.mark.parametrize("n", [1, 15, 16, 17, 1000, 40_000])
def test_bound_holds(kind, n):
    rng = np.random.default_rng(n)
    values = {"random": rng.normal(size=n), "sorted": np.arange(n, dtype=float), "reversed": -np.arange(n, dtype=float), "ties": rng.integers(0, 4, n).astype(float), "tails": np.exp(8 * rng.normal(size=n))}[kind]
    s = Summary(16)
    for part in np.array_split(values, 1 + n // 333):
        s.add_values(part)
    got_n, answers = s.percentiles(list(QS.values()))
    assert got_n == n
    for q, a in zip(QS.values(), answers):
        assert distance(values, a, q) <= s.err
    assert s.err <= n * max(1, math.log2(max(2, n / 16))) / 16
    if n < 16:
        assert s.err == 0


def test_merge_of_summaries_keeps_bound():
    rng = np.random.default_rng(1)
    whole, out = [], Summary(32)
    for i in range(60):
        values = rng.exponential(size=int(rng.integers(0, 900)))
        whole.append(values)
        s = Summary(32)
        s.add_values(values)
        out.err += s.err
        for level, buf in s.rows():
            if level == 0 and len(buf) < 32:
                out.add_values(buf)
            else:
                out.add_buffer(level, buf)
    whole = np.concatenate(whole)
    n, answers = out.percentiles(list(QS.values()))
    assert n == len(whole)
    assert all(distance(whole, a, q) <= out.err for q, a in zip(QS.values(), answers))


def rows_of(df):
    return {r["k"]: r for r in df.collect()}


def test_frames_days_and_hot_group(spark):
    rng = np.random.default_rng(2)
    data = [("hot", d, float(v)) for d in range(5) for v in rng.integers(0, 10**6, 900)] + [("few", 0, 3.0), ("few", 1, 3.0), ("one", 2, -7.5)]
    df = spark.createDataFrame(data, "k string, d int, v double").repartition(6)
    days = combine(summarise(df, ["k", "d"], "v", 64), ["k", "d"], 64)
    got = rows_of(percentiles(combine(days, ["k"], 64), ["k"], QS, 64))
    direct = rows_of(percentiles(summarise(df, ["k"], "v", 64), ["k"], QS, 64))
    for out in (got, direct):
        assert out["hot"]["n"] == 4500 and out["few"]["p50"] == 3.0 and out["one"]["p99"] == -7.5 and out["few"]["rank_error"] == 0
        values = np.array([v for k, _, v in data if k == "hot"])
        for name, q in QS.items():
            assert distance(values, out["hot"][name], q) <= out["hot"]["rank_error"] <= 4500 * 0.06


def test_nulls_empty_and_no_keys(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", None), ("a", float("nan")), ("a", 2.0)], "k string, v double")
    assert [tuple(r) for r in percentiles(summarise(df, ["k"], "v"), ["k"], {"m": 0.5}).collect()] == [("a", 1, 2.0, 0.0)]
    none = spark.createDataFrame([], "k string, v double")
    assert percentiles(combine(summarise(none, ["k"], "v"), ["k"]), ["k"], {"m": 0.5}).count() == 0
    whole = percentiles(combine(summarise(df, [], "v"), []), [], {"m": 0.5}).collect()
    assert [tuple(r) for r in whole] == [(2, 1.0, 0.0)]


def test_integer_column_and_extra_columns(spark):
    df = spark.createDataFrame([("a", 5, 1), ("a", 7, 1), ("a", 9, 1)], "k string, v bigint, level int")
    assert percentiles(summarise(df, ["k"], "v"), ["k"], {"m": 0.5}).first()["m"] == 7.0
    out = percentiles(combine(summarise(df, ["k", "level"], "v"), ["k", "level"]), ["level", "k"], {"m": 0.5}).first()
    assert out["level"] == 1 and out["k"] == "a" and out["m"] == 7.0


def test_null_key_is_a_group_where_asked(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", "x", 2.0), (None, "x", 3.0)], "k string, day string, v double")
    rows = percentiles(combine(summarise(df, ["k", "day"], "v", null_keys=("day",)), ["k", "day"]), ["k", "day"], QS).collect()
    assert sorted(((r["k"], r["day"], r["p50"]) for r in rows), key=repr) == [("a", "x", 2.0), ("a", None, 1.0)]
    assert percentiles(combine(summarise(df, ["k", "day"], "v"), ["k"]), ["k"], QS).first()["n"] == 1


def test_same_summaries_same_result_in_any_order(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([("a", float(v)) for v in rng.exponential(size=6000)], "k string, v double").repartition(12)
    rows = summarise(df, ["k"], "v", 32).collect()
    got = set()
    for seed in range(4):
        order = np.random.default_rng(seed).permutation(len(rows))
        again = spark.createDataFrame([rows[i] for i in order], "k string, summary_level int, summary_buf array<double>, summary_err double").coalesce(1)
        got.add(tuple(percentiles(combine(again, ["k"], 32), ["k"], QS, 32).first()))
    assert len(got) == 1 and next(iter(got))[-1] > 0
