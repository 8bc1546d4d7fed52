"""Lookups by a key of which a few values may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.runtime import shuffle_partitions

#: Most values of a column that are treated as heavy; their looked-up rows are broadcast.
MOST = 10_000


def heavy_values(df: DataFrame, *columns: str, most: int | None = None) -> dict[str, list]:
    """Per column, all values that more than 1 / ``most`` of the rows have, and perhaps a few others.

    At most ``most`` values a column (by default four per shuffle partition, no more than ``MOST``).
    One pass with counters of that number on the map side; no shuffle of rows. Nulls are left out.
    """
    most = min(MOST, most or 4 * shuffle_partitions(df.sparkSession))
    row = df.select(*columns).freqItems(list(columns), 1.0 / most).first()
    return {c: [x for x in (row[i] or []) if x is not None] for i, c in enumerate(columns)}


def spread_key(key: str, kind: str, heavy: list, salt: Column) -> Column:
    """``key``, with a salted stand-in for the heavy values, so that a shuffle spreads their rows.

    A stand-in may happen to equal another key; who joins by it ignores what heavy rows meet.
    """
    return F.when(F.col(key).isin(heavy), salt.cast(kind)).otherwise(F.col(key))


def spread_lookup(rows: DataFrame, key: str, table: DataFrame, table_key: str, value: str, out: str, heavy: list, salt: Column) -> DataFrame:
    """``rows`` with a column ``out``: ``value`` of the row of ``table`` with that key, else null.

    ``table`` has one row per key at most; its key is a bigint or a string, as that of ``rows``. Rows
    whose key is one of ``heavy`` get their value from a broadcast of at most ``len(heavy)`` rows and
    are spread over the tasks by ``salt``, a hash of what tells them apart; all others meet in an
    ordinary shuffled join. So no task gets many rows of one key, whatever the key's share.
    """
    kind = dict(rows.dtypes)[key]
    side = table.select(F.col(table_key).alias("__t"), F.col(value).alias("__v"))
    if not heavy:
        return rows.join(side, F.col(key) == F.col("__t"), "left").withColumn(out, F.col("__v")).drop("__t", "__v")
    small = side.where(F.col("__t").isin(heavy)).toDF("__h", "__hv")
    met = rows.withColumn("__k", spread_key(key, kind, heavy, salt)).join(side, F.col("__k") == F.col("__t"), "left")
    met = met.join(F.broadcast(small), F.col(key) == F.col("__h"), "left")
    return met.withColumn(out, F.when(F.col(key).isin(heavy), F.col("__hv")).otherwise(F.col("__v"))).drop("__k", "__t", "__v", "__h", "__hv")
