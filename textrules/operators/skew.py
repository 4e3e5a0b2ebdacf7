"""Joins in which one key may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it makes up at least this share of all rows; so there are at most
# 1 / HOT_SHARE hot keys, whatever the data.
HOT_SHARE = 0.001


def hot_of(counts: DataFrame, key: str, n: str, share: float = HOT_SHARE) -> DataFrame:
    """The keys whose count ``n`` is at least ``share`` of the sum: at most 1/share of them."""
    total = counts.agg(F.sum(n).alias("_total"))
    return (
        counts.join(F.broadcast(total))  # one row
        .filter(F.col(n) >= F.col("_total") * share)
        .select(key)
    )


def hot_keys(rows: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    return hot_of(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key, "_n", share)


def join_skewed(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Inner join of many rows with a side that has a bounded number of rows per key.

    Rows with hot keys meet a broadcast of the side's entries for those keys, so of at most
    that bound times 1/HOT_SHARE rows; only rows with other keys are shuffled.
    """
    hot = F.broadcast(hot_keys(rows, key))
    near = rows.join(F.broadcast(side.join(hot, key, "left_semi")), key)
    far = rows.join(hot, key, "left_anti").join(side, key)
    return near.unionByName(far)
