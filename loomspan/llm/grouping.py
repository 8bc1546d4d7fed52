"""Consolidating pairwise matches into groups by Hash-to-Min.

The clusters of all vertices are kept as undirected edges, each stored once as (hi, lo) with
lo < hi; the cluster C(v) is v with its neighbours. In a round every vertex v takes m = min C(v) and
sends C(v) to m and m to every other member:

* a vertex that is its own minimum sends what its edges say already, so its edges (u, v) stay as they
  are, and no row has to come together at the hub of a large cluster;
* any other v has m = min over its lower neighbours. An edge (v, lo) becomes (lo, m) where lo is not
  m itself, and an edge (hi, v) becomes (hi, m).

The message of v's own link to m is left out: v keeps, through its edge to m, a link to min C(m) or
to m, every such link leads down to the same local minimum, so no connection is lost.

A round is stable when every edge leads to a vertex without lower neighbours, which means that every
vertex holds the minimum of its group. Rounds are written to the shared folder, so that a lost
executor costs at most the current round. Nothing is collected per group. The ids that hold many
edges, as the minimum of a large group does in every round, are found by a counting pass with a fixed
number of counters; what they look up is broadcast, and their edges stay spread over all tasks
(``spread_lookup``). Adaptive execution could not split them, as one side of the join is an aggregate.

Ids that are no integers are numbered first, as rounds over 64-bit numbers sort and shuffle faster;
the numbers' order serves the rounds, and the least id of each group is found at the end.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators.skew import heavy_values, spread_lookup
from loomspan.runtime import Stored

MAX_ROUNDS = 100
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _tidy(spark) -> None:
    """Let the driver notice that the last round's shuffle files are no longer needed."""
    gc.collect()
    spark._jvm.System.gc()


def _links(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (hi, lo) of pairs of two different known ids."""
    x, y = (F.col(c).cast("bigint") for c in (a, b))
    ends = pairs.select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo"), (x.isNotNull() & y.isNotNull()).alias("ok"))
    return ends.where("ok and hi <> lo").select("hi", "lo").distinct()


def _rounds(edges: DataFrame, max_rounds: int) -> Stored:
    """Stored (hi, lo): every vertex but the minimum of its group, with that minimum."""
    kept = Stored(edges, "links")
    for _ in range(max_rounds):
        e = kept.df
        least = e.groupBy(F.col("hi").alias("v")).agg(F.min("lo").alias("m"))
        heavy = heavy_values(e, "hi", "lo")
        heavy = sorted({*heavy["hi"], *heavy["lo"]})  # one broadcast serves both lookups
        # what a vertex with lower neighbours sends down: m to each of them
        down = spread_lookup(e, "hi", least, "v", "m", "m", heavy, F.xxhash64("lo"))
        # what it sends up: m to each higher neighbour; edges to a local minimum stay
        up = spread_lookup(down, "lo", least, "v", "m", "m_lo", heavy, F.xxhash64("hi"))
        sent = up.select(
            F.inline(
                F.array(
                    F.struct(F.col("hi"), F.coalesce("m_lo", "lo").alias("lo"), F.col("m_lo").isNotNull().alias("moved")),
                    F.struct(F.when(F.col("lo") > F.col("m"), F.col("lo")).alias("hi"), F.col("m").alias("lo"), F.lit(True).alias("moved")),
                )
            )
        ).where("hi is not null")
        new = Stored(sent.groupBy("hi", "lo").agg(F.min("moved").alias("moved")), "links")
        open_edges = new.df.where("moved").limit(1).count()
        kept.drop()
        kept = new
        kept.df = new.df.select("hi", "lo")
        _tidy(edges.sparkSession)
        if not open_edges:
            return kept
    raise RuntimeError(f"not stable after {max_rounds} rounds")


def _labels(edges: DataFrame, max_rounds: int) -> DataFrame:
    """(id, group_id) of all vertices, in the order of the ids given."""
    done = _rounds(edges, max_rounds).df
    least = done.select(F.col("lo").alias("id")).distinct().withColumn("group_id", F.col("id"))
    return done.select(F.col("hi").alias("id"), F.col("lo").alias("group_id")).unionByName(least)


def _numbered(ids: DataFrame) -> Stored:
    """Stored (id, number) of the distinct values of the one column of ``ids``."""
    known = ids.toDF("id").where("id is not null").distinct()
    return Stored(known.withColumn("number", F.monotonically_increasing_id()), "numbers")


def _by_number(pairs: DataFrame, a: str, b: str, numbers: Stored, max_rounds: int) -> DataFrame:
    """Groups of the pairs whose ids both have a number."""
    both = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    heavy = heavy_values(both, "a", "b")
    both = spread_lookup(both, "a", numbers.df, "id", "number", "i", heavy["a"], F.xxhash64("b")).where("i is not null").select("i", "b")
    both = spread_lookup(both, "b", numbers.df, "id", "number", "j", heavy["b"], F.xxhash64("i")).where("j is not null").select("i", "j")
    labels = _labels(_links(both, "i", "j"), max_rounds).toDF("number", "root")
    named = Stored(labels.join(numbers.df, "number").select("id", "root"), "named").df
    least = named.groupBy("root").agg(F.min("id").alias("group_id"))
    groups = spread_lookup(named, "root", least, "root", "group_id", "group_id", heavy_values(named, "root")["root"], F.xxhash64("id"))
    return groups.select("id", "group_id")


def hash_to_min(pairs: DataFrame, a: str, b: str, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(id, group_id) of every id that is linked to another one; ``group_id`` is the group's least id.

    Defined cases: pairs with a null or of an id with itself link nothing; repeated and turned round
    pairs count once; ids are compared as their type compares (strings by code point); no pairs give
    no rows; other columns are ignored. Ids may be of any orderable type. The row of the least id of
    a group has id = group_id.
    """
    kind = dict(pairs.dtypes)[a]
    if kind in INTEGERS:
        return _labels(_links(pairs, a, b), max_rounds).select(*(F.col(c).cast(kind).alias(c) for c in ("id", "group_id")))
    ends = pairs.select(F.explode(F.array(a, b)).alias("id"))
    return _by_number(pairs, a, b, _numbered(ends), max_rounds)


def match_groups(matches: DataFrame, calls: DataFrame, a: str, b: str, call_id: str) -> DataFrame:
    """The groups over the pairs whose two ids both occur in ``calls``; see ``hash_to_min``."""
    return _by_number(matches, a, b, _numbered(calls.select(call_id)), MAX_ROUNDS)
