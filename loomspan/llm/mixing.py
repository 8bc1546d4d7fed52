"""Mixing sources to target weights.

Sizes are tokens of a public tokenizer, counted once for every text. Of the sources that have any
tokens, the total size of the mixture is the largest for which no source needs a text more than its
``max_repeats`` times; a source's repetition rate is then target * total / tokens. Each text is
emitted floor(rate) times, and once more if a hash of its id and the seed, as a number in [0, 1), is
below the rate's fraction. The choice depends on the id only, so it is the same in every run and
partitioning. Nothing but one row per listed source reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.encoding import count_tokens
from loomspan.runtime import Stored

#: Listed sources that a mixture may have; their rates are broadcast.
MAX_SOURCES = 100_000


def source_rates(sizes: DataFrame, targets: DataFrame) -> list[dict]:
    """One entry per listed source: source, target_share, max_repeats, docs, tokens, wanted_share, rate.

    ``sizes`` has source and tokens. ``wanted_share`` is the target, normalised to sum 1 over the
    sources with tokens; sources with none, or with a null, zero or negative target or repeat limit, have rate 0.
    """
    have = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
    rows = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).join(have, "source", "left").orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources are listed")
    out = [{"source": r["source"], "target_share": r["target_share"], "max_repeats": r["max_repeats"], "docs": r["docs"] or 0, "tokens": r["tokens"] or 0, "wanted_share": 0.0, "rate": 0.0} for r in rows]
    live = [r for r in out if r["tokens"] > 0 and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0]
    whole = sum(r["target_share"] for r in live)
    total = min((r["max_repeats"] * r["tokens"] * whole / r["target_share"] for r in live), default=0.0)
    for r in live:
        r["wanted_share"] = r["target_share"] / whole
        r["rate"] = min(float(r["max_repeats"]), total * r["wanted_share"] / r["tokens"])
    return out


def _emitted(rows: DataFrame, rates: list[dict], seed: int, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``rows`` with a column ``__copies``, without those that have none; a narrow step."""
    small = rows.sparkSession.createDataFrame([(r["source"], r["rate"]) for r in rates if r["rate"] > 0], "__source string, __rate double")
    share = F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11) / F.lit(float(1 << 53))
    copies = F.floor("__rate") + F.when(share < F.col("__rate") - F.floor("__rate"), 1).otherwise(0)
    met = rows.join(F.broadcast(small), F.col(source) == F.col("__source")).withColumn("__copies", copies.cast("int"))
    return met.drop("__source", "__rate").where("__copies > 0")


def token_sizes(docs: DataFrame, targets: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> Stored:
    """Stored (doc_id, source, tokens) of the texts whose source is listed.

    Every text is encoded here, once; the functions below take the result, so that a mixture, its
    shares and its documents cost one encoding of the corpus between them.
    """
    listed = targets.select(F.col("source").alias("__listed")).where("__listed is not null").distinct()
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    picked = picked.join(listed, F.col("source") == F.col("__listed"), "left_semi")
    return Stored(count_tokens(picked, "text", ["doc_id", "source"], vocabulary), "sizes")


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """One row per copy in the mixture: ``doc_id``, ``source``, ``copy`` (from 1), ``tokens``.

    ``sizes`` comes from ``token_sizes``. Documents with a null or unlisted source take no part; null
    and empty texts have size 0 and come out at their source's rate; an empty table, or no usable
    target, gives no rows. The shares are met in expectation; ``mixture_shares`` reports those really
    reached. Repeated rows of one id are chosen together.
    """
    chosen = _emitted(sizes, source_rates(sizes, targets), seed)
    return chosen.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("copy"), "tokens")


def mixed_documents(docs: DataFrame, sizes: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", seed: int = 0) -> DataFrame:
    """The documents of the mixture with all their columns, each as often as ``mix`` takes it.

    ``copy`` counts the copies of a row from 1 (a column of that name is replaced). A choice needs the
    row's id and its source's rate only, so no text is moved: the rates are broadcast to the documents.
    """
    chosen = _emitted(docs.drop("copy"), source_rates(sizes, targets), seed, doc_id, source)
    return chosen.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__copies")


def mixture_shares(sizes: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """One row per listed source: what it holds, its rate, and the share of the mixture it reached.

    ``target_share`` is as listed; ``wanted_share`` is that among the sources that hold anything.
    """
    rates = source_rates(sizes, targets)
    out = _emitted(sizes, rates, seed).groupBy("source").agg(F.sum("__copies").alias("copies"), F.sum(F.col("__copies") * F.col("tokens")).alias("tokens_out"))
    head = sizes.sparkSession.createDataFrame([tuple(r.values()) for r in rates], "source string, target_share double, max_repeats int, docs bigint, tokens bigint, wanted_share double, rate double")
    both = head.join(out, "source", "left").na.fill(0, ["copies", "tokens_out"])
    whole = both.agg(F.sum("tokens_out")).first()[0] or 0
    return both.withColumn("actual_share", F.when(F.lit(whole) > 0, F.col("tokens_out") / F.lit(whole)).otherwise(F.lit(0.0)))
