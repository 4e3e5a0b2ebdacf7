"""Session settings and the shared folder for written tables."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Buckets of tables that are stored by a key, unless the caller asks for more.
BUCKETS = 32
# Upper bound on what may be hinted as a broadcast side.
BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(app: str = "textrules", cpus: str | int = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_folders: dict[str, tempfile.TemporaryDirectory] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local master, where driver and executors share one machine, may fall back
    to a temporary folder when the setting is missing; it goes when the process ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.TemporaryDirectory(
            prefix="textrules-", ignore_cleanup_errors=True
        )
    return _local_folders[app].name


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/textrules/{app}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Like ``written``, but bucketed and sorted by ``key``: joins and groupings by it move nothing.

    For tables in which no key has many rows; a bucket is read by one task.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    rows = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    rows.option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows as text, by one aggregate over ``df``."""
    width = F.octet_length(F.to_json(F.struct(*df.columns)))
    return df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("n")).first()["n"]


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Measure ``df`` and tell whether it may be broadcast."""
    return measured_bytes(df) <= limit


def broadcast_parts(df: DataFrame, key: str, limit: int = BROADCAST_BYTES) -> list[DataFrame]:
    """``df`` as the fewest parts that each fit a broadcast, split evenly by hash of ``key``."""
    n = max(1, math.ceil(measured_bytes(df) / limit))
    if n == 1:
        return [F.broadcast(df)]
    part = F.pmod(F.xxhash64(key), F.lit(n))
    return [F.broadcast(df.filter(part == i)) for i in range(n)]


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when ``df`` is measured to fit; else leave the join to AQE."""
    return F.broadcast(df) if fits_broadcast(df, limit) else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Share rows of files out over all cores where their splits do not.

    A row group is read by one task, however many splits its file is cut into; so splits that hold
    rows are counted (by the files' footers), not splits. Where each core has one and no split has
    more than twice its share, the rows stay as they are, so this never shuffles large tables.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    split = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"))
    found = split.agg(F.count("n").alias("filled"), F.max("n").alias("most"), F.sum("n").alias("all")).first()
    if found["filled"] >= cores and found["most"] * cores <= 2 * found["all"]:
        return df
    return dealt(df, *keys)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Share rows out over all cores, whatever holds them: for batches that would be worked out twice to count."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()), *keys)
