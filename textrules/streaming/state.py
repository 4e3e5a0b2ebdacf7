"""What a stream knows between its batches: delta tables, and a log with one row a batch.

Below one folder of the shared storage lie ``<table>/batch_id=<n>`` and ``log/batch_id=<n>``.
A batch writes its own folders only, the log row last. It reads the log row of the batch before
(largest ids, sums) and, of earlier deltas, the buckets its own keys fall into: deltas lie in the
order of their buckets, so the scan skips the row groups of others. So what it reads grows with
the batch. A batch that was killed is run again by the stream: it overwrites what it
had left, finds the same log row and the same earlier deltas, and so ends the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a keyed table. A batch of few keys reads few of them; one that falls into most reads all.
BUCKETS = 1024


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")


class BatchState:
    """The state as one batch sees it. ``counters`` are the names of the log's columns."""

    def __init__(self, spark: SparkSession, path: str, batch_id: int, counters: tuple[str, ...]):
        self.spark, self.path, self.batch_id = spark, path, batch_id
        self.log_schema = T.StructType([T.StructField(c, T.LongType(), False) for c in counters])
        self.last = self._last()

    def _last(self) -> dict[str, int]:
        """The log row of the batch before: one small folder."""
        if self.batch_id == 0:
            return dict.fromkeys(self.log_schema.names, 0)
        folder = f"{self.path}/log/batch_id={self.batch_id - 1}"
        return self.spark.read.schema(self.log_schema).parquet(folder).first().asDict()

    def commit(self, **counters: int) -> None:
        row = self.spark.createDataFrame([tuple(counters[c] for c in self.log_schema.names)], self.log_schema)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/batch_id={self.batch_id}")

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """This batch's rows of a table, written and read back; in the order of ``bucket``, if they have one."""
        folder = f"{self.path}/{name}/batch_id={self.batch_id}"
        rows = df.sort("bucket") if "bucket" in df.columns else df
        rows.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def of_batch(self, name: str, schema: T.StructType, batch_id: int) -> DataFrame:
        """Another batch's rows of a table that is written whole each time; none before the first."""
        if batch_id < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/batch_id={batch_id}")

    def earlier(self, name: str, schema: T.StructType) -> DataFrame:
        """What the batches before this one have written, without a half-written try of this one."""
        if self.batch_id == 0:
            return self.spark.createDataFrame([], schema)
        stored = T.StructType([*schema.fields, T.StructField("batch_id", T.IntegerType())])
        table = self.spark.read.schema(stored).parquet(f"{self.path}/{name}")
        return table.filter(F.col("batch_id") < self.batch_id).drop("batch_id")

    def earlier_of_keys(self, name: str, schema: T.StructType, keys: DataFrame, key: str) -> DataFrame:
        """Earlier rows of a table with buckets for the keys in ``keys`` (key, bucket), by their buckets.

        The list of buckets, at most ``BUCKETS`` numbers, reaches the scan as a filter.
        """
        if self.batch_id == 0:
            return self.spark.createDataFrame([], schema)
        rows = self.earlier(name, T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())]))
        buckets = [r["bucket"] for r in keys.select("bucket").distinct().collect()]
        if len(buckets) <= BUCKETS // 2:
            rows = rows.filter(F.col("bucket").isin(*buckets) if buckets else F.lit(False))
        return rows.join(keys.select("bucket", key), ["bucket", key], "left_semi").select(*schema.names)
