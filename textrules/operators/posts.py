"""Filtering and paging of posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrules.sources.tables import month_of

PER_PAGE = 10


def filter_posts(
    posts: DataFrame,
    topic_id: int,
    source_ids: Sequence[int],
    from_date: str | None = None,
    to_date: str | None = None,
) -> DataFrame:
    """Posts of one topic and some sources, from the first to the last moment of two dates.

    An open end is unbounded; a post without a time is never in range. Posts stored by
    topic and month are read from the partitions in range only.
    """
    inside = (F.col("topic_id") == topic_id) & F.col("source_id").isin(*source_ids)
    inside &= F.col("ts").isNotNull()
    first = F.lit(f"{from_date} 00:00:00").cast("timestamp")
    last = F.lit(f"{to_date} 23:59:59").cast("timestamp")
    if from_date:
        inside &= F.col("ts") >= first
    if to_date:
        inside &= F.col("ts") <= last
    if "month" in posts.columns:
        if from_date:
            inside &= F.col("month") >= month_of(first)
        if to_date:
            inside &= F.col("month") <= month_of(last)
    return posts.filter(inside)


def posts_count(posts: DataFrame) -> DataFrame:
    return posts.agg(F.count(F.lit(1)).alias("posts_count"))


def posts_page(posts: DataFrame, page: int = 1, per_page: int = PER_PAGE) -> DataFrame:
    """One page of posts by ascending id, with the date as yyyy/MM/dd."""
    return (
        posts.orderBy("post_id")
        .offset((page - 1) * per_page)
        .limit(per_page)
        .select("post_id", "title", "url", F.date_format("ts", "yyyy/MM/dd").alias("date"))
    )


def last_page(count: Column, per_page: int = PER_PAGE) -> Column:
    return (F.floor(count / per_page) + 1).cast("long")


def day_range(rows: DataFrame, ts: str, since: str, until: str) -> DataFrame:
    """Rows from the start of ``since`` up to, not including, the start of ``until``."""
    kind = rows.schema[ts].dataType
    return rows.filter(
        (F.col(ts) >= F.lit(since).cast(kind)) & (F.col(ts) < F.lit(until).cast(kind))
    )
