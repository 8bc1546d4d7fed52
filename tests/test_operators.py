"""Small hand-computed cases of the operators' edges."""

import math

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
from loomspan.operators import stats as T
from loomspan.operators import sweep as W


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(spark, expr, **cols):
    ddl = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'bigint'}" for k, v in cols.items())
    return spark.createDataFrame([tuple(cols.values())], ddl).select(expr.alias("x")).first()["x"]


def test_islands_gap_and_rules(spark):
    df = spark.createDataFrame([("c", 0, 100), ("c", 10, 20), ("c", 30, 40), ("c", 140, 150), ("c", 191, 200)], "k string, s bigint, e bigint")
    assert [(r["s"], r["e"]) for r in L.merge_islands(df, ["k"], "s", "e", 40).orderBy("s").collect()] == [(0, 150), (191, 200)]
    assert len(L.merge_islands(df, ["k"], "s", "e", 5, "last").collect()) == 4
    assert L.union_length(df, ["k"], "s", "e").first()["bp"] == 119


def test_gaps_closed(spark):
    df = spark.createDataFrame([("c", 1, 5), ("c", 6, 9), ("c", 15, 20)], "k string, s bigint, e bigint")
    assert rows(L.list_gaps(df, ["k"], "s", "e", closed=True)) == [("c", 10, 14)]


def test_overlap_touching_long_and_reversed(spark):
    a = spark.createDataFrame([("c", 1, 0, 10), ("c", 2, 20, 10), ("c", 3, 0, 300_000_000), (None, 4, 0, 5)], "k string, i int, s bigint, e bigint")
    b = spark.createDataFrame([("c", 10, 12), ("c", 5_000_000, 5_000_001), ("c", 0, 200_000_000)], "k2 string, s2 bigint, e2 bigint")
    got = rows(I.overlap_join(a, b, [("k", "k2")], I.Span("s", "e"), I.Span("s2", "e2")).select("i", "s2", "overlap"))
    assert got == [(1, 0, 10), (2, 0, 10), (2, 10, 2), (3, 0, 200_000_000), (3, 10, 2), (3, 5_000_000, 1)]
    closed = rows(I.overlap_join(a, b, [("k", "k2")], I.Span("s", "e", True), I.Span("s2", "e2", True)).where("i = 1").select("s2", "overlap"))
    assert closed == [(0, 11), (10, 1)]


def test_overlap_against_brute_force(spark):
    import random

    rng = random.Random(1)
    make = lambda n: [(rng.choice("ab"), i, s := rng.randint(0, 10**8), s + rng.choice([1, 100, 10**5, 10**7])) for i in range(n)]
    x, y = make(60), make(80)
    a = spark.createDataFrame(x, "k string, i int, s bigint, e bigint")
    b = spark.createDataFrame(y, "k2 string, j int, s2 bigint, e2 bigint")
    want = sorted((i, j) for k, i, s, e in x for k2, j, s2, e2 in y if k == k2 and s < e2 and s2 < e)
    got = [tuple(r) for r in I.overlap_join(a, b, [("k", "k2")], I.Span("s", "e"), I.Span("s2", "e2")).select("i", "j").collect()]
    assert sorted(got) == want
    semi = {r["i"] for r in I.overlap_semi(a, b, [("k", "k2")], I.Span("s", "e"), I.Span("s2", "e2"), "i").collect()}
    anti = {r["i"] for r in I.overlap_semi(a, b, [("k", "k2")], I.Span("s", "e"), I.Span("s2", "e2"), "i", anti=True).collect()}
    assert semi == {i for i, _ in want} and anti == set(range(60)) - semi


def test_lift_over_strands_and_ambiguity(spark):
    p = spark.createDataFrame([(1, "q", 110, 120), (2, "q", 210, 220), (3, "q", 305, 310), (4, "q", 900, 910)], "i int, c string, s bigint, e bigint")
    b = spark.createDataFrame([("q", 100, 200, "t", 1000, 1100, "+"), ("q", 200, 300, "t", 2000, 2100, "-"), ("q", 300, 400, "t", 0, 100, "+"), ("q", 300, 400, "u", 0, 100, "+")], "q_name string, q_start bigint, q_end bigint, t_name string, t_start bigint, t_end bigint, block_strand string")
    assert rows(I.lift_over(p, b, "i", [("c", "q_name")], I.Span("s", "e"))) == [(1, "lifted", "t", 1010, 1020), (2, "lifted", "t", 2080, 2090), (3, "ambiguous", None, None, None), (4, "no_block", None, None, None)]


def test_nearest_tie_sign_and_missing(spark):
    p = spark.createDataFrame([(1, "c", 50), (2, "c", 15), (3, "d", 5), (4, "c", 62)], "i int, k string, p bigint")
    f = spark.createDataFrame([("c", 10, 20, "a", "+"), ("c", 81, 90, "b", "-")], "k string, s bigint, e bigint, g string, st string")
    got = rows(I.nearest(p, f, ["k"], "p", "i", I.Span("s", "e"), "g", "st"))
    assert got == [(1, "a", 31, "left", 31), (2, "a", 0, "inside", 0), (3, None, None, None, None), (4, "b", 19, "right", 19)]


def test_nearest_against_brute_force(spark):
    import random

    rng = random.Random(8)
    feats = [(rng.choice("ab"), s := rng.randint(0, 900), s + rng.choice([1, 5, 40, 300]), i) for i in range(40)]
    pts = [(i, rng.choice("abc"), rng.randint(-50, 1300)) for i in range(200)]
    f = spark.createDataFrame(feats, "k string, s bigint, e bigint, g int")
    p = spark.createDataFrame(pts, "i int, k string, p bigint")
    got = {r["i"]: (r["distance"], r["side"]) for r in I.nearest(p, f, ["k"], "p", "i", I.Span("s", "e"), "g", shard=64).collect()}
    for i, k, x in pts:
        mine = [(s, e) for fk, s, e, _ in feats if fk == k]
        inside = any(s <= x < e for s, e in mine)
        left, right = [x - e + 1 for _, e in mine if e <= x], [s - x for s, _ in mine if s > x]
        want = (0, "inside") if inside else (None, None) if not mine else (min(left), "left") if left and (not right or min(left) <= min(right)) else (min(right), "right")
        assert got[i] == want


def test_strand_flanks_swap(spark):
    df = spark.createDataFrame([(100, 200, "+"), (100, 200, "-")], "s bigint, e bigint, st string")
    assert rows(I.strand_flanks(df, I.Span("s", "e"), "st", 150))[0] == (100, 200, "+", 0, 100, 200, 350)
    assert rows(I.strand_flanks(df, I.Span("s", "e"), "st", 150))[1] == (100, 200, "-", 200, 350, 0, 100)


def test_reciprocal_best(spark):
    """A best that two records choose is nobody's match, even if it prefers one of them."""
    c = spark.createDataFrame([("a1", "b1", 10.0), ("a2", "b1", 8.0), ("a3", "b3", 5.0), ("a4", "b3", 5.0), ("a6", "b6", 7.0), ("a6", "b7", 6.0), ("a8", "b8", 3.0), ("a8", "b9", 2.0)], "a string, b string, score double")
    assert rows(M.reciprocal_best(c, "a", "b", "score")) == []
    one_each = c.where("a in ('a1', 'a6', 'a8') and b not in ('b7', 'b9')")
    assert rows(M.reciprocal_best(one_each, "a", "b", "score")) == [("a1", "b1", 10.0), ("a6", "b6", 7.0), ("a8", "b8", 3.0)]


def test_match_outcomes(spark):
    schema = "a string, b string, score double, ro double, profile double, jaccard double, containment double"
    c = spark.createDataFrame([("a1", "b1", 9.0, 0.9, None, None, None), ("a2", "b2", 9.0, 0.9, 0.6, None, None), ("a3", "b3", 5.0, 0.8, None, None, None), ("a4", "b3", 4.0, 0.8, None, None, None), ("a5", "b5", 8.0, 0.8, None, None, None), ("a5", "b6", 7.0, 0.8, None, None, None), ("i1", "j1", 9.0, None, None, 0.6, 0.9), ("i2", "j1", 8.0, None, None, 0.6, 0.9)], schema)
    recs = spark.createDataFrame([(x, "INS" if x[0] == "i" else "TRA" if x == "a9" else "DEL", "no_block" if x in ("a8", "i3") else "ok") for x in "a1 a2 a3 a4 a5 a7 a8 a9 i1 i3 i4".split()] + [("a10", None, "ok")], "a string, kind string, lift string")
    got = {r["a"]: (r["status"], r["confidence"]) for r in M.match_outcomes(recs, c, "a", "b", "score").collect()}
    assert got == {
        "a1": ("shared_strict_liftover", "high"), "a2": ("shared_strict_liftover", "medium"), "a3": ("ambiguous_many_to_one", "low"), "a4": ("ambiguous_many_to_one", "low"), "a5": ("ambiguous_one_to_many", "low"),
        "a7": ("RefA_only_publication_lifted_no_match", "medium"), "a8": ("ambiguous_synteny", "low"), "a9": ("unresolved_unsupported_svtype", "low"), "a10": ("unresolved_unsupported_svtype", "low"),
        "i1": ("ins_unresolved", "low"), "i3": ("ins_unresolved", "low"), "i4": ("ins_unresolved", "low"),
    }
    back = {r["b"]: r["status"] for r in M.match_outcomes(spark.createDataFrame([("b3", "DEL", "ok"), ("b6", "DEL", "ok"), ("b0", "DEL", "ok")], "b string, kind string, lift string"), c, "b", "a", "score", True).collect()}
    assert back == {"b3": "ambiguous_many_to_one", "b6": "ambiguous_one_to_many", "b0": "RefB_only_publication_lifted_no_match"}


def test_sequence_similarity(spark):
    df = spark.createDataFrame([("ACGTACGTACGTTTT", "acgtacgtacgtttt"), ("AACCGGTATTGACCA", "TGGTCAATACCGGTT"), ("ACG", "ACG"), ("ACG", "CGT"), ("", "A"), (None, "A")], "a string, b string")
    got = [r["m"] for r in df.select(M.sequence_similarity(F.col("a"), F.col("b")).alias("m")).collect()]
    assert got[4] is None and got[5] is None
    assert [tuple(m) for m in got[:4]] == [(1.0, 1.0, "same", 5), (1.0, 1.0, "reverse_complement", 5), (1.0, 1.0, "same", 5), (1.0, 1.0, "reverse_complement", 5)]


def test_three_states(spark):
    assert one(spark, P.combine_states(F.col("a").cast("int"), F.col("b").cast("int")), a=1, b=0) == 1
    assert one(spark, P.combine_states(F.col("a"), F.lit(None)), a=0) == 0
    gt = {"0/0": 0, "0/1": 1, "./.": None, "1|2": 1, ".": None, "0|.": 0, "0/1:35": 1}
    for k, v in gt.items():
        assert one(spark, P.genotype_state(F.col("g")), g=k) == v
    assert [one(spark, P.genotype_strict(F.col("g")), g=k) for k in ("0/1", "1|1", "1/2", "0/0")] == [True, True, False, False]


@pytest.mark.parametrize("cell,numeric,token,truthy", [("", False, False, False), (".", False, False, False), ("NA", False, False, False), ("0", False, False, False), ("0.0", False, True, False), ("1", True, True, True), ("2", True, True, False), ("TRUE", True, True, True), ("0/0", False, True, False), ("./.", False, True, False), ("0/1", True, True, False), (None, False, False, False)])
def test_presence_rules(spark, cell, numeric, token, truthy):
    c = F.col("v")
    assert (one(spark, P.presence_numeric(c), v=cell), one(spark, P.presence_token(c), v=cell), one(spark, P.presence_truthy(c), v=cell)) == (numeric, token, truthy)


def test_pan_core_exact_by_hand(spark):
    f = spark.createDataFrame([(1,), (1,), (2,), (3,), (3,), (3,), (3,)], "n_samples bigint")
    got = {r["k"]: (r["pan"], r["core"]) for r in P.pan_core_exact(f, 3).collect()}
    want = {1: (16 / 3, 16 / 3), 2: (19 / 3, 13 / 3), 3: (7, 4)}
    assert all(math.isclose(got[k][i], want[k][i]) for k in want for i in (0, 1))


def test_exhaustive_is_mean_of_exact(spark):
    m = spark.createDataFrame([(1,), (3,), (7,), (7,), (4,), (15,)], "mask bigint")
    cur = P.pan_core_exhaustive(m.withColumn("item", F.monotonically_increasing_id()), 4).collect()
    assert len(cur) == 15
    freq = m.select(F.bit_count("mask").cast("bigint").alias("n_samples"))
    for r in P.pan_core_exact(freq, 4).collect():
        mine = [c for c in cur if c["k"] == r["k"]]
        assert math.isclose(sum(c["pan"] for c in mine) / len(mine), r["pan"]) and math.isclose(sum(c["core"] for c in mine) / len(mine), r["core"])


def test_distance_bins(spark):
    want = {-1: ("-0.5k~0k", -250), -500: ("-0.5k~0k", -250), -501: ("-1k~-0.5k", -750), 0: ("0k~0.5k", 250), 500: ("0.5k~1k", 750), 5000: ("5k~5.5k", 5250), -5000: ("-5k~-4.5k", -4750), 5001: (">5k", 5500), -5001: ("<-5k", -5500)}
    assert {k: tuple(one(spark, S.distance_bin(F.col("d")), d=k)) for k in want} == want
    assert tuple(one(spark, S.distance_bin(F.col("d"), F.lit(True)), d=7)) == ("Gene", 0) and tuple(one(spark, S.distance_bin(F.lit(None).cast("bigint")), d=7)) == (">5k", 5500)


def test_n50_half_and_quantiles(spark):
    df = spark.createDataFrame([("x", v) for v in (5, 3, 1, 1)], "k string, v bigint")
    assert L.n50(df, ["k"], "v").first()["n50"] == 5
    assert df.agg(T.linear_quantile("v", 0.5).alias("q")).first()["q"] == 2.0
    assert df.where("v = 5").agg(T.linear_quantile("v", 0.9).alias("q")).first()["q"] == 5.0


def test_sweep_and_paint(spark):
    df = spark.createDataFrame([("c", "low", 0, 100), ("c", "high", 40, 60), ("c", "low", 90, 120)], "k string, cls string, s bigint, e bigint")
    assert rows(W.priority_bp(df, ["k"], "cls", "s", "e", ["high", "low"])) == [("c", "high", 20), ("c", "low", 100)]
    total = sum(r["bp"] for r in W.priority_bp(df, ["k"], "cls", "s", "e", ["high", "low"]).collect())
    assert total == L.union_length(df, ["k"], "s", "e").first()["bp"]
    reg = spark.createDataFrame([("r", 50, 130)], "r string, a bigint, b bigint")
    it = df.select(F.lit("r").alias("r"), "cls", "s", "e")
    assert rows(W.paint(it, reg, "r", "a", "b", "s", "e", "cls", ["s"])) == [("r", "Others", 10), ("r", "low", 70)]


def test_sequences(spark):
    assert one(spark, S.reverse_complement(F.col("s")), s="acgtn") == "NACGT"
    assert one(spark, S.translate_codons(F.col("s")), s="ATGTAANNNCC") == "M*X"
    assert one(spark, S.fourfold_sites(F.col("s")), s="GCTATGCCN") == "T"
    assert one(spark, S.codon_positions_12(F.col("s")), s="ATGCCA") == "ATCC"
    assert one(spark, M.kmers(F.col("s"), 3), s="ACGTA") == ["ACG", "CGT", "GTA"] and one(spark, M.kmers(F.col("s"), 9), s="ACG") == []
    assert one(spark, S.sub_sequence(F.col("s"), F.lit(1), F.lit(4), F.lit("-")), s="AACGG") == "CGT"
    assert one(spark, S.insertion_sequence(F.lit("A"), F.col("s")), s="A" + "C" * 30) == "C" * 30 and one(spark, S.insertion_sequence(F.lit("A"), F.col("s")), s="ACC") is None
    assert one(spark, S.breakend(F.col("s"))[0], s="N]chr2:321]") == "chr2" and one(spark, S.breakend(F.col("s"))[1], s="N]chr2:321]") == 321
    assert len(S.FOURFOLD) == 8


def test_texts_and_numbers(spark):
    assert one(spark, S.info_text(F.col("s")), s="END=5;FLAG;A=1;") == "FLAG;A=1;END=5"
    assert [one(spark, S.safe_int(F.col("s")), s=x) for x in ("3.9", "-3.9", "x", "nan", " 7 ")] == [3, -3, None, None, 7]
    assert one(spark, S.list_cell(F.col("s"), ",", r"[^|]*\|", r"\.\d+"), s=" sp|g1.1, ,sp|g2.12") == ["g1", "g2"]
    assert one(spark, S.canonical_labels(F.col("s"), {"a": "A"}, ["x"]), s="a,b,A,x,b") == ["A", "b"]
    assert one(spark, S.ltr_age(F.lit(0.2), jukes_cantor=True), s="") is None
    assert one(spark, K.packed_numbers(F.col("s")), s="1_2.5__nan_x_3") == [1.0, 2.5, 3.0]


def test_mann_whitney_and_erfc(spark):
    df = spark.createDataFrame([("k", "x", float(v)) for v in (1, 2, 2, 5)] + [("k", "y", float(v)) for v in (2, 6, 7)], "k string, g string, v double")
    r = T.mann_whitney(df, ["k"], "g", "x", "y", "v").first()
    # U counts pairs x > y, ties half
    assert r["u"] == 1 + 2 * 0.5 and 0 < r["p"] < 1
    for x in (-2.0, 0.0, 0.3, 1.0, 3.0):
        assert math.isclose(one(spark, T.erfc(F.col("x")), x=x), math.erfc(x), rel_tol=2e-7)


def test_correlations(spark):
    df = spark.createDataFrame([("a", 1.0, 10.0), ("a", 2.0, 100.0), ("a", 3.0, 1000.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0)], "k string, x double, y double")
    got = {r["k"]: r["spearman"] for r in T.spearman(df, ["k"], "x", "y").collect()}
    assert math.isclose(got["a"], 1.0) and got["b"] is None
    boot = T.bootstrap_mean(df.where("k = 'a'"), ["k"], "y", 300, 1).first()
    assert 10 <= boot["lo"] <= 370 <= boot["hi"] <= 1000


def test_greedy_fallback_parents(spark):
    b = spark.createDataFrame([("p", 3, [1, 2, 3]), ("q", 2, [3, 4]), ("r", 2, [2, 3]), ("s", 0, [])], "b string, n int, m array<int>")
    assert rows(M.greedy_exclusive(b, "b", "n", "m")) == [("p",), ("q",)]
    left = spark.createDataFrame([(1, "X_LTR"), (2, "Y"), (3, "Z")], "i int, k string")
    right = spark.createDataFrame([("X_INT", "one"), ("Y", "two")], "key string, v string")
    got = M.fallback_join(left, right, [F.col("k"), F.regexp_replace("k", "_LTR$", "_INT")], "key", "i")
    assert rows(got.select("i", "key_rank", "v")) == [(1, 1, "one"), (2, 0, "two"), (3, None, None)]
    f = spark.createDataFrame([("exon", "mrna"), ("mrna", "gene"), ("x", "unknown")], "f string, p string")
    assert dict(rows(M.resolve_parent(f, "f", "p", 2).select("f", "root"))) == {"exon": "gene", "mrna": "gene", "x": "unknown"}


def test_checks_fail(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Exception, match="repeated keys"):
        R.unique_or_fail(df, ["k"]).collect()
    with pytest.raises(Exception, match="unknown key"):
        R.must_know(df, "k", df.where("k = 2"), "k").collect()
    with pytest.raises(Exception, match="not in all inputs"):
        C.lock_step({"a": df.withColumn("v", F.lit(1)).limit(1), "b": df.where("k = 2").withColumn("v", F.lit(1))}, "k", ["v"]).collect()


def test_solo_and_segments(spark):
    e = spark.createDataFrame([(1, "c", 0, 50), (2, "c", 1000, 1500), (3, "c", 90_000, 90_500), (4, "c", 500_000, 500_400)], "i int, c string, s bigint, e bigint")
    full = spark.createDataFrame([("c", 1400, 9000)], "c string, s bigint, e bigint")
    internal = spark.createDataFrame([("c", 100_000, 101_000)], "c string, s bigint, e bigint")
    assert dict(rows(C.solo_elements(e, full, internal, "c", "s", "e", "i").select("i", "reason"))) == {1: "short", 2: "in_complete", 3: "near_internal", 4: "solo"}
    g = spark.createDataFrame([("c", 1, "r"), ("c", 2, "r"), ("c", 3, "b"), ("c", 4, None), ("c", 5, None)], "c string, o int, col string")
    assert [tuple(r)[2:] for r in K.ancestral_segments(g, ["c"], "o", "col").orderBy("first").collect()] == [("r", 1, 2, 2), ("b", 3, 3, 1), (None, 4, 5, 2)]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k string, s bigint, e bigint, v double")
    assert L.merge_islands(e, ["k"], "s", "e").count() == 0
    assert I.overlap_join(e, e.toDF("k2", "s2", "e2", "v2"), [("k", "k2")], I.Span("s", "e"), I.Span("s2", "e2")).count() == 0
    assert W.priority_bp(e.withColumn("c", F.lit("x")), ["k"], "c", "s", "e", ["x"]).count() == 0
    assert T.spearman(e, ["k"], "s", "v").count() == 0
