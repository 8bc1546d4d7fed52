"""Mixtures: shares, repeat limits, and sources that can take no part."""

import pytest

from loomspan.llm.mixing import mix, mixed_documents, mixture_shares, source_rates, token_sizes
from loomspan.llm.queries import VOCABULARY


@pytest.fixture
def docs(spark):
    rows = [(i, f"word {i} some text of a few words", "big") for i in range(3000)] + [(10_000 + i, f"word {i} some text of a few words", "small") for i in range(200)]
    rows += [(20_000 + i, "x", None) for i in range(5)] + [(30_000, "x", "other"), (40_000, None, "small"), (40_001, "", "small")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def targets(spark, *rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_and_limits(spark, docs):
    t = targets(spark, ("big", 0.6, 2), ("small", 0.3, 3), ("absent", 0.1, 5))
    sizes = token_sizes(docs, t, VOCABULARY).df
    rows = mix(sizes, t).collect()
    copies = {}
    for r in rows:
        copies.setdefault((r["source"], r["doc_id"]), []).append(r["copy"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in copies.values())
    assert max(len(c) for (s, _), c in copies.items() if s == "small") == 3 and max(len(c) for (s, _), c in copies.items() if s == "big") <= 2
    assert {s for s, _ in copies} == {"big", "small"}
    size = {s: sum(r["tokens"] for r in rows if r["source"] == s) for s in ("big", "small")}
    assert abs(size["big"] / sum(size.values()) - 2 / 3) < 0.02
    shares = {r["source"]: r for r in mixture_shares(sizes, t).collect()}
    assert shares["absent"]["rate"] == 0 and shares["absent"]["actual_share"] == 0 and shares["small"]["rate"] == 3
    assert abs(shares["big"]["wanted_share"] - 2 / 3) < 1e-9 and shares["absent"]["wanted_share"] == 0
    for s, n in size.items():
        assert shares[s]["tokens_out"] == n and abs(shares[s]["actual_share"] - n / sum(size.values())) < 1e-12


def test_same_choice_in_any_partitioning(spark, docs):
    t = targets(spark, ("big", 0.5, 1), ("small", 0.5, 2))
    a, b = (sorted((r["doc_id"], r["copy"]) for r in mix(token_sizes(d, t, VOCABULARY).df, t).collect()) for d in (docs.repartition(7), docs.coalesce(1)))
    assert a == b
    assert a != sorted((r["doc_id"], r["copy"]) for r in mix(token_sizes(docs, t, VOCABULARY).df, t, seed=1).collect())


def test_rates(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 50), ("b", 50), ("zero", 0)], "source string, tokens bigint")
    r = {x["source"]: x for x in source_rates(sizes, targets(spark, ("a", 0.5, 4), ("b", 0.5, 2), ("zero", 0.2, 9), ("none", None, 1), ("off", 0.1, 0), (None, 0.1, 1)))}
    assert r["a"]["rate"] == r["b"]["rate"] == 2.0 and r["zero"]["rate"] == 0 and r["none"]["rate"] == 0 and None not in r


def test_documents_of_the_mixture(spark, docs):
    t = targets(spark, ("big", 0.6, 2), ("small", 0.3, 3))
    sizes = token_sizes(docs, t, VOCABULARY).df
    wide = docs.selectExpr("*", "'x' as copy", "1.5 as rate", "text as tokens", "3 as copies")
    out = mixed_documents(wide, sizes, t)
    assert sorted(out.columns) == sorted(wide.columns)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = out.collect()
    assert sorted((r["doc_id"], r["copy"]) for r in rows) == sorted((r["doc_id"], r["copy"]) for r in mix(sizes, t).collect())
    assert all(r["text"] == r["tokens"] == texts[r["doc_id"]] for r in rows)
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_nothing_to_mix(spark, docs):
    def sizes(d, t):
        return token_sizes(d, t, VOCABULARY).df

    t, gone = targets(spark, ("big", 1.0, 1)), targets(spark, ("absent", 1.0, 1))
    none = docs.limit(0)
    assert mix(sizes(none, t), t).count() == 0 and mixed_documents(none, sizes(none, t), t).count() == 0
    assert mix(sizes(docs, gone), gone).count() == 0 and mixed_documents(docs, sizes(docs, gone), gone).count() == 0
    assert mixture_shares(sizes(none, t), t).first()["actual_share"] == 0
