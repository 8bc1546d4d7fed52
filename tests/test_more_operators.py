"""Hand-computed cases of the operators that no query covers."""

import math
import random

import pytest

from pyspark.sql import functions as F

from loomspan.functions import scalars as S
from loomspan.operators import composites as C
from loomspan.operators import intervals as I
from loomspan.operators import islands as L
from loomspan.operators import karyotype as K
from loomspan.operators import matching as M
from loomspan.operators import pav as P
from loomspan.operators import relational as R
from loomspan.operators import signal as G
from loomspan.operators import stats as T


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_coordinates(spark):
    df = spark.createDataFrame([(30, 10, "+", 100), (5, None, "-", 100), (90, 99, "-", 100)], "s bigint, e bigint, st string, n bigint")
    assert rows(I.normalise(df, "s", "e").select("s", "e")) == [(10, 30), (5, None), (90, 99)]
    assert rows(I.expand(df.where("s = 90"), "s", "e", 95, 100).select("s", "e")) == [(0, 100)]
    assert I.expand(df.where("s = 90"), "s", "e", 0, 50).count() == 0
    assert rows(I.flip_to_plus(df.where("s = 90"), "s", "e", "st", "n").select("s", "e")) == [(1, 10)]


def test_small_scalars(spark):
    one = spark.range(1)

    def x(c):
        return one.select(c.alias("x")).first()["x"]

    lo, hi = S.trim_core(F.lit(1), F.lit(20), 5)
    assert (x(lo), x(hi)) == (6, 15)
    lo, hi = S.trim_core(F.lit(1), F.lit(9), 5)
    assert (x(lo), x(hi)) == (4, 6)
    assert [x(S.p_stars(F.lit(p))) for p in (0.0001, 0.005, 0.04, 0.5)] == ["***", "**", "*", "ns"] and x(S.p_stars(F.lit(None).cast("double"))) == "NA"
    assert x(S.relative_position(F.lit(5), F.lit(1), F.lit(9))) == "within" and x(S.relative_position(F.lit(0), F.lit(2_000_000), F.lit(9_000_000))) == "left 2.00 Mb"
    assert math.isclose(x(S.gap_fraction(F.lit("A--C"))), 0.5) and x(S.gap_fraction(F.lit(""))) is None
    assert x(S.strip_prefix(F.lit("ab.chr1"), ["ab.", "cd."])) == "chr1" and x(S.missing_to_null(F.lit(" NA "))) is None
    assert [x(S.read_confidence(F.lit(c), F.lit(n))) for c, n in (("high", 2), ("low", 1), ("low", 0), ("", 0))] == ["high_read_svgap_supported", "medium_read_svgap_supported", "low", "."]
    assert [x(S.assembly_confidence(F.lit(t), F.lit(n))) for t, n in (("DEL", 2), ("DEL", 1), ("INV", 0))] == ["medium_svgap_combined", "low_svgap_only", "medium_svgap_only"]
    assert x(S.translocation_type(F.lit("BND"))) == "TRA" and x(S.te_broad(F.lit("LTR_retrotransposon"), F.lit("LTR/Gypsy"))) == "LTR/Gypsy"
    assert [x(S.size_class(F.lit(n))) for n in (49, 50, -499, 500, 5000)] == [None, "50-499", "50-499", "500-4999", ">=5000"]
    assert [x(P.orthology_class(F.array(*map(F.lit, c)), F.lit(c[0]))) for c in ((1, 1), (2, 3), (1, 2), (3, 0), (0, 2))] == ["single", "multi", "other", "unique", "absent"]
    assert x(P.support_states(F.lit("101"), 3)) == [1, 0, 1] and x(P.support_states(F.lit("10"), 3)) is None
    assert x(P.list_cell_sizes(F.lit("a, ,b,"))) == 2 and x(M.length_ratio_ok(F.lit(0), F.lit(9))) and not x(M.length_ratio_ok(F.lit(10), F.lit(16)))


def test_blocks_and_breakpoints(spark):
    b = spark.createDataFrame([("q", 0, 100, "t1", 500, 600), ("q", 100, 400, "t2", 0, 300), ("q", 900, 990, "t1", 1, 91)], "q_name string, q_start bigint, q_end bigint, t_name string, t_start bigint, t_end bigint")
    r = spark.createDataFrame([("x", "q", 120, 130)], "name string, chrom string, start bigint, end bigint")
    assert rows(K.project_blocks(b, r, 50).select("r_name", "t_name", "bp", "rank")) == [("x", "t1", 100, 2), ("x", "t2", 300, 1)]
    bl = spark.createDataFrame([("c", 0, 40, "a"), ("c", 45, 48, "a"), ("c", 60, 90, "b"), ("c", 52, 55, "b")], "chrom string, start bigint, end bigint, ancestry string")
    w = spark.createDataFrame([("j1", "c", 30, 70, "a", "b"), ("j2", "d", 0, 9, "a", "b")], "w string, chrom string, win_start bigint, win_end bigint, l string, r string")
    assert rows(K.breakpoint_flanks(bl, w, "w", "l", "r")) == [("j1", 48, 52, "narrow")]


def test_signal_helpers(spark):
    d = spark.createDataFrame([("v", 5.0), ("v", 9.0), ("w", 1.0), ("w", 20.0), ("x", 5.0), ("x", 5.0), ("y", None)], "r string, d double")
    assert dict(rows(G.flank_depth_gate(d, "r", "d", 3, 6).select("r", "reason"))) == {"v": "pass", "w": "low_min", "x": "low_mean", "y": "no_depth"}
    data = [(0, 100, 40, 160, 500, 600), (0, 100, 300, 400, 60, 90), (0, 100, None, None, 90, 1000), (None, None, 5, 9, None, None), (None, None, None, None, 7, 8), (None,) * 6]
    c = spark.createDataFrame(data, "a int, b int, c int, d int, e int, f int")
    got = c.select(G.consensus_interval((F.col("a"), F.col("b")), (F.col("c"), F.col("d")), (F.col("e"), F.col("f"))).alias("x")).collect()
    assert [tuple(r["x"]) if r["x"] else None for r in got] == [
        (0, 160, "raw,relaxed", "discordant_excluded", 0, "raw_relaxed_concordant;q20_discordant_excluded"),
        (0, 400, "raw,relaxed,q20", "concordant_or_partly_overlapping", 30, "raw_relaxed_broad_or_split;q20_included"),
        (0, 100, "raw", "discordant_excluded", 10, "raw_only;q20_discordant_excluded"),
        (5, 9, "relaxed", "missing", 0, "relaxed_only"),
        (7, 8, "q20", "concordant_or_partly_overlapping", 1, "q20_only;q20_included"),
        None,
    ]
    s = spark.createDataFrame([("c", 25)], "k string, n bigint")
    v = spark.createDataFrame([("c", 10, 2.0)], "k string, win_start bigint, v double")
    assert rows(G.complete_windows(v, s, ["k"], "n", 10, {"v": 0.0})) == [("c", 0, 0.0), ("c", 10, 2.0), ("c", 20, 0.0)]
    o = spark.createDataFrame([("b", "x", 5), ("b", "y", 9), ("b", "x", 4)], "bin string, src string, bp bigint")
    assert rows(G.dominant_source(o, ["bin"], "src", "bp")) == [("b", "x", "x:9;y:9")]


def test_regions_and_demotion(spark):
    f = spark.createDataFrame([("r1", 5, 9)], "reg string, s bigint, e bigint")
    g = spark.createDataFrame([("r1", 100, "chr1")], "name string, off bigint, contig string")
    assert rows(C.region_to_contig(f, g.withColumnRenamed("name", "reg"), "reg", "off", "s", "e").select("s", "e", "contig")) == [(105, 109, "chr1")]
    assert rows(C.scope_fraction(spark.createDataFrame([("c", 0, 10), ("c", 5, 10), ("c", 20, 30), ("d", 0, 5)], "k string, s bigint, e bigint"), ["k"], "s", "e", 100)) == [(25, 0.25)]
    src = spark.createDataFrame([("alone", True), ("both", True), ("both", False), ("both", None), ("read", False)], "src string, ok boolean")
    assert rows(C.demote(src, "src", F.col("ok"), ["alone"], {"both": "read"}).select("src", "decision", "new_source")) == sorted([("alone", "drop", "alone"), ("both", "keep", "both"), ("both", "demote", "read"), ("both", "demote", "read"), ("read", "keep", "read")], key=repr)


def test_islands_over_shard_borders(spark):
    w = L.SHARD
    data = [("k", w - 5, w), ("k", w, w + 5), ("k", 2 * w - 1, 4 * w + 1), ("k", 4 * w + 3, 4 * w + 9), ("k", 10, 20), ("k", 15, 16), ("j", 5, 5), ("k", -7, 3)]
    df = spark.createDataFrame(data, "k string, s bigint, e bigint")
    got = rows(L.merge_islands(df, ["k"], "s", "e").select("k", "s", "e", "n"))
    assert got == sorted([("k", w - 5, w + 5, 2), ("k", 2 * w - 1, 4 * w + 1, 1), ("k", 4 * w + 3, 4 * w + 9, 1), ("k", 10, 20, 2), ("j", 5, 5, 1), ("k", -7, 3, 1)], key=repr)
    assert rows(L.merge_islands(df.where("k = 'k'"), ["k"], "s", "e", 2).select("s", "e", "n")) == sorted([(w - 5, w + 5, 2), (2 * w - 1, 4 * w + 9, 2), (10, 20, 2), (-7, 3, 1)], key=repr)
    assert L.union_length(df, ["k"], "s", "e").where("k = 'k'").first()["bp"] == 10 + 2 * w + 2 + 6 + 10 + 10


def test_other_statistics(spark):
    e = spark.createDataFrame([("k", float(v), 3.0) for v in (1, 2, 3, 4)], "k string, v double, o double")
    r = T.empirical_p(e, ["k"], "v", "o").first()
    assert (r["ge"], r["p"]) == (2, 3 / 5)
    g = T.kde(e, ["k"], "v", -5.0, 10.0, 301, 0.5).collect()
    assert abs(sum(x["density"] for x in g) * 15 / 300 - 1) < 1e-3
    h = spark.createDataFrame([("s", d, c) for d, c in enumerate([900, 500, 90, 5, 10, 60, 100, 60, 30, 40, 70, 120, 190, 120, 60, 10], 1)], "s string, depth bigint, count bigint")
    low = spark.createDataFrame([("t", 1, 7), ("t", 2, 1)], "s string, depth bigint, count bigint")
    got = {r["s"]: r for r in T.genome_size(h.unionByName(low), ["s"], "depth", "count", 4, 1).collect()}
    assert (got["s"]["peak"], got["s"]["rule"]) == (13, "highest_smoothed_peak") and got["s"]["size_all"] == round(sum(d * c for d, c in enumerate([900, 500, 90, 5, 10, 60, 100, 60, 30, 40, 70, 120, 190, 120, 60, 10], 1)) / 13)
    assert (got["t"]["peak"], got["t"]["size_all"], got["t"]["rule"]) == (None, None, "no_peak_after_min_depth")
    # the top lies at 7 and a maximum of a tenth of its height near twice that depth
    t = spark.createDataFrame([("s", d, c) for d, c in enumerate([9, 9, 9, 5, 10, 600, 1000, 600, 30, 4, 7, 50, 190, 50, 6, 1], 1)], "s string, depth bigint, count bigint")
    assert T.genome_size(t, ["s"], "depth", "count", 4, 1).first()["peak"] == 13
    m = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "i int, s string")
    assert rows(R.same_sets(m.select("s"), m.select("s"))) == [(True,)] and rows(R.same_sets(m.select("s"), m.where("i < 3").select("s"))) == [(False,)]
    big = spark.createDataFrame([(7,), (10**8 - 1,), (10**8,), (123456789,), (123456780,)], "n bigint")
    assert [r[0] for r in big.select(R.padded(F.col("n"), 8)).collect()] == ["00000007", "99999999", "100000000", "123456789", "123456780"]
    assert [r["sid"] for r in R.surrogate_ids(m, ["i"], "Z", 4).orderBy("i").collect()] == ["Z0001", "Z0002", "Z0003"]
    assert P.sample_columns(spark.createDataFrame([], "id int, genome_a int, genome_b int, x int"), ["id"], ["genome_b"], "genome_") == ["genome_a"]


def test_batch_functions(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, v int")
    assert rows(M.apply_groups(df, ["k"], lambda p: p.assign(v=p.v.sum())[["k", "v"]].head(1), "k string, v int")) == [("a", 3), ("b", 5)]

    def twice(part):
        yield part
        yield part

    assert M.apply_batches(df, twice, "k string, v int").count() == 6


def test_masks_hold_63_samples_or_fail(spark):
    df = spark.createDataFrame([("a", 0), ("a", 62), ("b", 5)], "item string, o int")
    assert rows(P.masks(df, "item", "o")) == [("a", 1 + 2**62), ("b", 32)]
    for bad in (63, 64, -1):
        with pytest.raises(Exception, match="no bit for sample ordinal"):
            P.masks(spark.createDataFrame([("a", bad)], "item string, o int"), "item", "o").collect()


def test_greedy_on_two_sides(spark):
    rng = random.Random(3)
    for _ in range(6):
        blocks = [(f"b{i:02d}", rng.randint(1, 6), rng.choice([0.1, 0.2, None]), [rng.randint(0, 12) for _ in range(rng.randint(0, 4))], [rng.randint(0, 12) for _ in range(rng.randint(1, 4))]) for i in range(40)]
        seen, want = (set(), set()), []
        for b, _, _, m, o in sorted(blocks, key=lambda x: (-x[1], float("inf") if x[2] is None else x[2], x[0])):
            if all(len(s) and sum(x not in done for x in s) >= 0.5 * len(s) for s, done in zip((m, o), seen)):
                want.append(b)
                seen[0].update(m)
                seen[1].update(o)
        df = spark.createDataFrame(blocks, "b string, n int, p double, m array<int>, o array<int>")
        assert [r[0] for r in rows(M.greedy_exclusive(df, "b", "n", "m", other="o", tie="p"))] == sorted(want)


def test_nearest_of_intervals(spark):
    p = spark.createDataFrame([("in", "c", 5, 50), ("left", "c", 75, 80), ("right", "c", 84, 88), ("tie", "c", 76, 84), ("cover", "c", 0, 1000), ("none", "d", 1, 2)], "id string, k string, s bigint, e bigint")
    f = spark.createDataFrame([("f1", "c", 10, 20, "+"), ("f2", "c", 60, 70, "-"), ("f3", "c", 90, 95, "+")], "f string, k string, fs bigint, fe bigint, st string")
    got = {r["id"]: (r["nearest_f"], r["distance"], r["side"], r["signed"]) for r in I.nearest(p, f, ["k"], "s", "id", I.Span("fs", "fe"), "f", "st", point_end="e").collect()}
    assert got == {"in": ("f1", 0, "inside", 0), "left": ("f2", 6, "left", -6), "right": ("f3", 3, "right", -3), "tie": ("f2", 7, "left", -7), "cover": ("f1", 0, "inside", 0), "none": (None, None, None, None)}


def upgma(names, d):
    """Leaves of the tree by the plain procedure: the closest two clusters merge."""
    groups = {i: [i] for i in range(len(names))}
    tree, nxt = {}, len(names)
    while len(groups) > 1:
        _, a, b = min((sum(d[i][j] for i in groups[a] for j in groups[b]) / len(groups[a]) / len(groups[b]), a, b) for a in groups for b in groups if a < b)
        tree[nxt] = (a, b)
        groups[nxt] = groups.pop(a) + groups.pop(b)
        nxt += 1

    def walk(x):
        return [names[x]] if x < len(names) else walk(tree[x][0]) + walk(tree[x][1])

    return walk(nxt - 1)


def test_leaf_order(spark):
    rng = random.Random(8)
    for n in (2, 3, 9, 25):
        pos = [(rng.random(), rng.random()) for _ in range(n)]
        d = [[math.dist(p, q) for q in pos] for p in pos]
        names = [f"n{i:02d}" for i in range(n)]
        pairs = [(names[i], names[j], d[i][j]) if rng.random() < 0.5 else (names[j], names[i], d[i][j]) for i in range(n) for j in range(i)]
        got = T.leaf_order(spark.createDataFrame(pairs, "a string, b string, d double"), "a", "b", "d").orderBy("pos").collect()
        assert [r["leaf"] for r in got] == upgma(names, d)
    with pytest.raises(ValueError):
        T.leaf_order(spark.createDataFrame(pairs, "a string, b string, d double"), "a", "b", "d", 5)


def test_stored_scope(spark, tmp_path):
    from loomspan import runtime

    df = spark.createDataFrame([("a", 1)], "k string, v int")
    outer = runtime.Stored(df, "outer")
    with runtime.stored_scope():
        inner = runtime.Stored(df, "inner")
        assert inner.df.count() == 1
    assert outer in runtime._LEFT and inner not in runtime._LEFT and outer.df.count() == 1
    outer.drop()


def test_paint_by_positions(spark):
    rng = random.Random(5)
    from loomspan.operators import sweep as W

    regions = [("r1", 10, 90), ("r2", 0, 30), ("empty", 5, 5), ("bare", 3, 8)]
    its = [(rng.choice(["r1", "r2", "zz"]), a, a + rng.randint(0, 30), rng.choice(["x", "y", None]), rng.choice([1, 2, 3, None])) for a in (rng.randint(0, 100) for _ in range(60))]
    want = {}
    for r, s, e in regions:
        for p in range(s, e):
            over = [((o is not None, o or 0), (c is not None, c or "")) for q, a, b, c, o in its if q == r and a <= p < b]
            c = min(over)[1][1] if over else "Others"
            c = c or "Others"
            want[(r, c)] = want.get((r, c), 0) + 1
    df = spark.createDataFrame(its, "reg string, a bigint, b bigint, c string, o int")
    rg = spark.createDataFrame(regions, "reg string, rs bigint, re bigint")
    assert {(r["reg"], r["c"]): r["bp"] for r in W.paint(df, rg, "reg", "rs", "re", "a", "b", "c", ["o"]).collect()} == want


def test_running_totals_and_quantiles(spark):
    rng = random.Random(2)
    data = [(rng.choice("ab"), rng.randint(0, 40)) for _ in range(500)] + [("c", 7), ("d", None)]
    df = spark.createDataFrame(data, "k string, v int")
    got = {r["k"]: (r["m"], r["q"]) for r in T.group_quantiles(df, ["k"], "v", {"m": 0.5, "q": 0.9}).collect()}
    want = {r["k"]: (r["m"], r["q"]) for r in df.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("m"), F.percentile("v", F.lit(0.9)).alias("q")).collect() if r["k"] != "d"}
    assert got.keys() == want.keys() and all(math.isclose(a, b) for k in got for a, b in zip(got[k], want[k]))
    assert math.isclose(T.group_quantiles(df, [], "v", {"m": 0.25}).first()["m"], df.agg(F.percentile("v", F.lit(0.25))).first()[0])
    assert T.group_quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0


def test_resampling_by_plain_sums(spark):
    rows = [(i, "ab"[i % 2], float(i % 7), float(i * i % 11)) for i in range(300)] + [(301, "a", None, 1.0)]
    df = spark.createDataFrame(rows, "id bigint, k string, x double, y double")
    a, b = (sorted(map(tuple, T.bootstrap_sums(d, ["k"], ["id"], ["x", "y"], 30, 4).collect())) for d in (df.repartition(5), df.coalesce(1)))
    assert all(p[:2] == q[:2] and all(math.isclose(u, v) for u, v in zip(p[2:], q[2:])) for p, q in zip(a, b)) and len(a) == 60
    assert abs(sum(r[2] for r in a) / (300 * 30) - 1) < 0.05
    d = T.bootstrap_distance(df, ["k"], "x", "y", 200, 1, ["id"]).collect()
    assert all(r["n"] == 150 and r["lo"] < r["distance"] < r["hi"] and abs(r["mean"] - r["distance"]) < 0.05 and r["rounds"] == 200 for r in d)
    flat = T.bootstrap_distance(df.withColumn("x", F.lit(1.0)), ["k"], "x", "y", 20, 1, ["id"]).first()
    assert flat["distance"] is None and flat["mean"] is None and flat["rounds"] == 0


def test_flanks_and_semi_against_plain(spark):
    rng = random.Random(11)
    pts = [(f"p{i}", rng.choice("cd"), a, a + rng.randint(1, 60)) for i, a in enumerate(rng.randint(0, 900) for _ in range(80))]
    fts = [(f"f{i:03d}", rng.choice("cd"), a, a + rng.randint(0, 25)) for i, a in enumerate(rng.randint(0, 900) for _ in range(120))] + [("g", None, 1, 2), ("h", "c", None, 2)]
    p = spark.createDataFrame(pts, "id string, k string, s bigint, e bigint")
    f = spark.createDataFrame(fts, "f string, k string, a bigint, b bigint")
    want = set()
    for i, k, s, e in pts:
        for side in ("left", "right"):
            near = sorted((s - b if side == "left" else a - e, x) for x, q, a, b in fts if q == k and a is not None and (b <= s if side == "left" else a >= e))
            want |= {(i, side, r + 1, x, d) for r, (d, x) in enumerate(near[:3]) if d < 40}
    for shard in (64, 1 << 22):
        assert set(map(tuple, I.flank_neighbours(p, f, ["k"], I.Span("s", "e"), "id", I.Span("a", "b"), "f", 40, 3, shard).collect())) == want
    over = {i for i, k, s, e in pts if any(q == k and a is not None and a < e and s < b for _, q, a, b in fts)}
    assert {r["id"] for r in I.overlap_semi(p, f, [("k", "k")], I.Span("s", "e"), I.Span("a", "b"), "id").collect()} == over
    assert {r["id"] for r in I.overlap_semi(p, f, [("k", "k")], I.Span("s", "e"), I.Span("a", "b"), "id", anti=True).collect()} == {x[0] for x in pts} - over


def test_segments_over_shard_borders(spark):
    from loomspan.operators import sweep as W

    w, rng = L.SHARD, random.Random(4)
    edge = [0, w, 2 * w, 3 * w]
    pos = lambda: rng.choice(edge) + rng.choice([0, 0, -3, -1, 1, 2, 5])
    data = [(rng.choice("ab"), *sorted((pos(), pos())), rng.choice(["x", "y", "z"])) for _ in range(40)] + [("c", -5, 4 * w + 3, "x"), ("c", w, w + 9, "y"), ("d", 7, 7, "x"), ("e", None, 5, "x")]
    df = spark.createDataFrame(data, "k string, s bigint, e bigint, c string")
    depth, owner = set(), set()
    for k in "abc":
        mine = [(s, e, c) for q, s, e, c in data if q == k and s < e]
        for seg, rule in ((depth, None), (owner, ("y", "x"))):
            use = [x for x in mine if rule is None or x[2] in rule]
            cuts = sorted({p for s, e, _ in use for p in (s, e)})
            for a, b in zip(cuts, cuts[1:]):
                over = [c for s, e, c in use if s <= a and b <= e]
                if over:
                    seg.add((k, a, b, len(over) if rule is None else min(over, key=rule.index)))
    assert set(map(tuple, W.depth_segments(df, ["k"], "s", "e").collect())) == depth
    assert set(map(tuple, W.priority_segments(df, ["k"], "c", "s", "e", ["y", "x"]).collect())) == owner


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_nearest_ordinal_in_ranges(spark, parts):
    rng = random.Random(parts)
    a = [(i, rng.choice("cde"), rng.randint(0, 60)) for i in range(150)] + [(200, "c", None)]
    b = [(f"r{i:02d}", rng.choice("cd"), rng.randint(0, 60)) for i in range(40)] + [("none", "c", None)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["i"]: (r["r"], r["distance"]) for r in I.nearest_ordinal(spark.createDataFrame(a, "i int, k string, x int"), spark.createDataFrame(b, "r string, k string, y int"), ["k"], "x", "i", "y", "r").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    for i, k, x in a:
        near = [(abs(x - y), y > x, r) for r, q, y in b if q == k and y is not None] if x is not None else []
        assert got[i] == ((min(near)[2], min(near)[0]) if near else (None, None)), (i, k, x)
