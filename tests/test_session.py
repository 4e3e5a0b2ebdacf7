"""Rows of files over the cores."""

from pyspark.sql import functions as F

from textrules.session import new_folder, spread


def rows_of_splits(df):
    return sorted(r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect())


def test_one_row_group_in_many_splits_is_dealt_out(spark):
    path = new_folder(spark, "one-group")
    texts = F.expr("array_join(transform(sequence(1, 100), k -> md5(concat(id, ':', k))), ' ')")
    spark.range(0, 8000, 1, 1).withColumn("text", texts).write.parquet(path)
    table = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    assert table.rdd.getNumPartitions() >= cores and len(rows_of_splits(table)) == 1
    dealt = spread(table)
    assert len(rows_of_splits(dealt)) == cores and max(rows_of_splits(dealt)) < 2 * 8000 / cores
    assert dealt.exceptAll(table).isEmpty() and dealt.count() == 8000


def test_even_splits_stay_where_they_are(spark):
    path = new_folder(spark, "even-splits")
    spark.range(0, 80000, 1, 2 * spark.sparkContext.defaultParallelism).write.parquet(path)
    table = spark.read.parquet(path).repartition(8)
    assert spread(table) is table
