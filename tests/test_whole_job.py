"""Queries that once left out a part of their input, against their SQL without that condition."""

import os

import pytest
from conftest import DATA, against_sql

from loomspan.plans import QUERIES, SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
LENGTH = (" WHERE c_end - c_start < 1000000 AND ", " WHERE ")


def whole(spark, name, *cuts, d=DATA):
    """Rows of a query and of its SQL with each (part, other part) replaced."""
    sql = SQL[name]
    for a, b in cuts:
        sql = sql.replace(a, b)
    return against_sql(spark, QUERIES[name], sql, d)


@pytest.mark.parametrize("name", ["priority_sweep", "dominant_class", "overlap_fractions", "repeat_decay"])
def test_calls_of_all_lengths(spark, name):
    got, want = whole(spark, name, LENGTH, (" AND c_end - c_start < 1000000", ""), d=DATA.replace("sf0.001", "sf0.01"))
    assert got == want


def test_greedy_over_all_calls(spark):
    """All calls, plainly from the longest down."""
    from loomspan.plans.signal_plans import _calls

    claimed, want = set(), []
    for c in sorted(_calls(spark, DATA).collect(), key=lambda c: (c.c_start - c.c_end, c.id)):
        bins = {(c.chrom, b) for b in range(c.c_start // 50_000, (c.c_end - 1) // 50_000 + 1)}
        if bins and len(bins - claimed) >= 0.5 * len(bins):
            want.append(c.id)
            claimed |= bins
    assert sorted(r[0] for r in QUERIES["greedy_exclusive"](spark, DATA).collect()) == sorted(want)


def test_greedy_takes_one_of_equal_blocks(spark):
    from loomspan.operators.matching import greedy_exclusive

    rows = [("a", 5, [1, 2]), ("b", 5, [2, 1]), ("c", 9, [2, 3]), ("d", 9, [3, 2]), ("e", 1, [4])]
    got = greedy_exclusive(spark.createDataFrame(rows, "b string, n int, m array<int>"), "b", "n", "m").collect()
    assert sorted(r[0] for r in got) == ["a", "c", "e"]


def test_greedy_on_two_axes(spark):
    """All calls, plainly from the longest down, on both axes."""
    from loomspan.plans.signal_plans import _calls

    claimed, want = (set(), set()), []
    for c in sorted(_calls(spark, DATA).collect(), key=lambda c: (c.c_start - c.c_end, float("inf") if c.qual is None else -c.qual, c.id)):
        sides = [{(c.chrom, b) for b in range((c.c_start + x) // 50_000, (c.c_end - 1 + x) // 50_000 + 1)} for x in (0, 25_000)]
        if all(s and len(s - done) >= 0.5 * len(s) for s, done in zip(sides, claimed)):
            want.append(c.id)
            for s, done in zip(sides, claimed):
                done |= s
    assert sorted(r[0] for r in QUERIES["greedy_two_sided"](spark, DATA).collect()) == sorted(want)


PRESENCE = "shared_specific presence_spectrum family_categories category_matrix pan_core_exact pan_core_exhaustive pan_core_subsets pan_core_summary mask_jaccard orthology_classes low_copy_families"


@pytest.mark.parametrize("name", PRESENCE.split())
def test_presence_from_all_purchases(spark, name):
    core = (" SELECT nation, count(*) FILTER (n_samples >= 8", " SELECT nation, count(*) FILTER (n_samples = 25) AS core, count(*) FILTER (n_samples >= 8")
    got, want = whole(spark, name, (" WHERE l_returnflag = 'R'", ""), core)
    assert got == want


def test_core_items_are_counted(spark, tmp_path):
    """One part that all nations bought, under any flag, and one that a single nation bought."""
    tables = {
        "lineitem": ([(i, 7, "ANR"[i % 3]) for i in range(25)] + [(3, 8, "N")], "l_orderkey long, l_partkey long, l_returnflag string"),
        "orders": ([(i, i) for i in range(25)], "o_orderkey long, o_custkey long"),
        "customer": ([(i, i) for i in range(25)], "c_custkey long, c_nationkey int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["nation"]: (r["core"], r["softcore"], r["dispensable"], r["private"]) for r in QUERIES["category_matrix"](spark, str(tmp_path)).collect()}
    assert got == {i: (1, 0, 0, int(i == 3)) for i in range(25)}


def test_elements_of_one_hit(spark):
    got, want = whole(spark, "merged_hits", (" WHERE n > 1", ""))
    assert got == want


def test_flanks_of_all_calls(spark):
    got, want = whole(spark, "flank_neighbours", (" AND type = 'INV'", ""))
    assert got == want


@pytest.mark.parametrize("name", ["histogram", "histogram_peaks"])
def test_bins_of_all_prices(spark, name):
    got, want = whole(spark, name, ("least(floor(l_extendedprice / 5000), 19)", "CASE WHEN l_extendedprice = 100000 THEN 19 ELSE floor(l_extendedprice / 5000) END"), (" WHERE l_extendedprice BETWEEN 0 AND 100000", ""))
    assert got == want


def test_similarity_of_short_texts(spark, tmp_path):
    rows = [(1, "a", "abcdefgh"), (2, "a", "abcdefxy"), (3, "a", "z")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["jaccard"], r["containment"]) for r in QUERIES["kmer_similarity"](spark, str(tmp_path)).collect()}
    assert got == {1: (round(2 / 6, 9), 0.5), 2: (0.0, None)}


def test_all_sequences_of_a_text(spark, tmp_path):
    rows = [(1, "a", "A" * 60 + " and " + "C" * 60 + " and " + "C" * 60)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in QUERIES["consensus"](spark, str(tmp_path)).collect()] == [("a", "C" * 60)]
    assert [tuple(r) for r in QUERIES["nucleotide_diversity"](spark, str(tmp_path)).collect()] == [("a", round(2 / 3, 8), 60)]
