"""Text files to lines and posts. ``files`` has columns path and value (the whole text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textrules.functions import text as tx


# On a local disk the checksum layer cannot open names with a colon, such as "… 16:52:01 ….txt".
# These settings concern file: paths only.
_COLON_NAMES = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
}


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, so that line order within a file is known."""
    files = spark.read.options(**_COLON_NAMES).text(path, wholetext=True)
    return files.select(decoded_path(), "value")


def stream_text_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    files = (
        spark.readStream.options(**_COLON_NAMES)
        .option("maxFilesPerTrigger", str(files_per_batch))
        .text(path, wholetext=True)
    )
    return files.select(decoded_path(), "value")


def decoded_path() -> Column:
    """The file's path with escapes such as %20 undone."""
    return F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("path")


def file_name(path: str | Column = "path") -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(path: str | Column = "path") -> Column:
    """File name without its last extension."""
    return F.regexp_extract(file_name(path), r"^(.*?)(?:\.[^.]*)?$", 1)


def text_lines(files: DataFrame) -> DataFrame:
    """path, line_no, line; blank lines are dropped before numbering."""
    return files.select("path", F.posexplode(tx.lines(F.col("value"))).alias("line_no", "line"))


def article_posts(files: DataFrame) -> DataFrame:
    """Article layout: title, url, then body lines; the time is the file name up to the first _."""
    lines = tx.lines(F.col("value"))
    return files.select(
        "path",
        F.get(lines, F.lit(0)).alias("title"),
        F.get(lines, F.lit(1)).alias("url"),
        F.regexp_extract(file_name(), r"^([^_]*)_", 1).alias("stamp"),
        F.array_join(F.slice(lines, 3, F.size(lines)), "\n").alias("text"),
    )


def batch_posts(files: DataFrame) -> DataFrame:
    """Batch layout: a title line, then body; the time is the end of ``min - max (n).txt``."""
    lines = tx.lines(F.col("value"))
    return files.select(
        "path",
        tx.strip(F.get(lines, F.lit(0))).alias("title"),
        F.regexp_extract(file_name(), r" - (\S+ \S+)", 1).alias("stamp"),
        F.array_join(F.slice(lines, 2, F.size(lines)), "\n").alias("text"),
    )


def new_files(files: DataFrame, posts: DataFrame, topic_id: int, source_id: int) -> DataFrame:
    """Files whose stem is not yet the title of a post of that topic and source."""
    known = posts.filter(
        (F.col("topic_id") == topic_id) & (F.col("source_id") == source_id)
    ).select(F.col("title").alias("_stem"))
    return (
        files.withColumn("_stem", file_stem()).join(known, "_stem", "left_anti").drop("_stem")
    )


def limit_docs(docs: DataFrame, key: str, text: str = "text", n: int = 75_000) -> DataFrame:
    """The first ``n`` documents with any words left after ``normalize``, by unique key; all of
    them when ``n`` is not positive. Only keys are sorted; the documents stay in place."""
    plain = F.col(text).rlike("[A-Za-z0-9]")  # always left by normalize, so it need not run
    filled = docs.filter(plain | (tx.normalize(F.col(text)) != ""))
    if n <= 0:
        return filled
    last = filled.select(key).orderBy(key).limit(n).agg(F.max(key).alias("_last"))
    return filled.join(F.broadcast(last), F.col(key) <= F.col("_last")).drop("_last")  # one row
