"""Joins to one-row-per-key tables when a few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table of at most so many rows (one per key) may be broadcast.
BROADCAST_ROWS = 20_000
#: A key is hot if it holds over 1/HOT_SHARE of the rows: there are fewer than HOT_SHARE such keys.
HOT_SHARE = 500


def join_lookup(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, total: int) -> DataFrame:
    """Left join to ``right`` (unique, non-null ``key``), with no task fed by a hot key.

    ``counts`` has ``key`` and ``count``, the rows of ``left`` by key. Keys over
    the hot share are fewer than ``HOT_SHARE`` by construction, so their rows of
    ``right`` are broadcast; the rows of ``left`` they serve are spread at random
    in the shuffle that joins all others.
    """
    payload = [c for c in right.columns if c != key]
    hot = counts.where(F.col("count") * HOT_SHARE > F.lit(int(total))).select(key)
    served = right.join(F.broadcast(hot), key, "left_semi")
    served = served.select(key, F.struct(*payload).alias("_hot"))
    first = left.join(F.broadcast(served), key, "left")
    first = first.withColumn("_spread", F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), F.rand(7) + 1).otherwise(F.lit(0.0)))
    others = right.select(key, F.struct(*payload).alias("_cold"), F.lit(0.0).alias("_spread"))
    both = first.join(others, [key, "_spread"], "left")
    taken = F.coalesce("_hot", "_cold")
    return both.select(*(F.col(c) for c in left.columns), *(taken[c].alias(c) for c in payload))


def join_small(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join to ``right`` (unique, non-null ``key``): broadcast if its counted rows allow, else ``join_lookup``."""
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, "left")
    counts = left.groupBy(key).count()
    return join_lookup(left, right, key, counts, left.count())
