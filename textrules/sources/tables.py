"""Stored posts: partitioned by topic and month, clustered by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONTH = "yyyy-MM"
PARTITIONS = ["topic_id", "month"]


def month_of(ts: Column) -> Column:
    """The month of a moment in UTC, whatever the session's time zone: writers and readers agree."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), MONTH)


def write_posts(posts: DataFrame, path: str) -> DataFrame:
    """Write posts and read them back with a ``month`` column that filters can prune by.

    Ranges over (topic, month, id) are even however large one topic or month is; each file
    covers a narrow range of ids, so bounds on the id skip row groups.
    """
    monthly = posts.withColumn("month", month_of(F.col("ts")))
    order = [*PARTITIONS, "post_id"]
    monthly.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(
        *PARTITIONS
    ).parquet(path)
    columns = [f for f in monthly.schema.fields if f.name not in PARTITIONS]
    columns += [monthly.schema[name] for name in PARTITIONS]
    return posts.sparkSession.read.schema(T.StructType(columns)).parquet(path)
