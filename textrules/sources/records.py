"""Files of time-stamped records: cutting, reversing and batching them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrules.functions import text as tx
from textrules.operators.numbering import number_rows
from textrules.sources.text_files import file_name

# Fixed value: new order of the six words of a range label ("a b - c d (n)" to "c d - a b (n)").
RANGE_ORDER = (3, 4, 2, 0, 1, 5)
PER_BATCH = 100


def _parts(files: DataFrame) -> DataFrame:
    """Cut each file in place at the line breaks that a time stamp follows."""
    body = F.regexp_replace("value", r"\n\z", "")
    stripped = F.array_join(F.transform(F.split(body, "\n"), tx.strip), "\n")
    parts = F.split(stripped, rf"\n(?={tx.STAMP})")
    headed = ~F.get("_parts", F.lit(0)).rlike(rf"^{tx.STAMP}")
    return files.withColumn("_parts", parts).select(
        "path",
        F.when(headed, F.get("_parts", F.lit(0))).otherwise("").alias("header"),
        F.when(headed, F.slice("_parts", 2, F.size("_parts"))).otherwise(F.col("_parts"))
        .alias("records"),
    )


def assemble_records(files: DataFrame) -> DataFrame:
    """One row per record; the lines before the first record are the file's header."""
    return _parts(files).select(
        "path", "header", F.posexplode("records").alias("record_no", "record")
    )


def swap_range(label: Column) -> Column:
    """Swap the two ends of a range label; anything shorter than a label stays."""
    words = F.split(label, " ")
    swapped = F.array_join(F.array(*[F.get(words, F.lit(i)) for i in RANGE_ORDER]), " ")
    return F.when((F.length(label) >= 10) & (F.size(words) >= 6), swapped).otherwise(label)


def reverse_records(files: DataFrame) -> DataFrame:
    """Same files with records in reverse order and the range in name and header swapped."""
    header = F.array_join(F.transform(F.split("header", "\n"), swap_range), "\n")
    return _parts(files).select(
        swap_range(file_name()).alias("name"),
        F.concat_ws(
            "\n", F.when(F.col("header") != "", header), F.reverse("records")
        ).alias("value"),
    )


def chunk_batches(rows: DataFrame, ts: str, key: str, text: str, per: int = PER_BATCH) -> DataFrame:
    """Batches of ``per`` rows a day by (time, key): folder, label ``min - max (n)`` and lines."""
    stamped = rows.select(
        F.col(ts).cast("timestamp").alias("ts"),
        F.to_date(ts).alias("day"),
        F.col(key).cast("long").alias("key"),
        tx.stamped_line(F.col(ts), F.col(text)).alias("line"),
    ).withColumn("micros", F.unix_micros("ts"))
    numbered = number_rows(stamped, lead="micros", tail="key", by=["day"])
    moment = "yyyy-MM-dd HH:mm:ss"
    lines = F.array_sort(F.collect_list(F.struct("rnum", "line")))  # at most ``per``
    return (
        numbered.groupBy("day", F.floor(F.col("rnum") / per).cast("int").alias("batch_no"))
        .agg(
            F.min("ts").alias("_min"), F.max("ts").alias("_max"),
            F.count(F.lit(1)).alias("n"), lines.alias("_lines"),
        )
        .select(
            F.concat(F.lit("posts_"), F.date_format("day", "yyyy_MM")).alias("folder"),
            "day", "batch_no", "n",
            F.format_string(
                "%s - %s (%d)", F.date_format("_min", moment), F.date_format("_max", moment), "n"
            ).alias("label"),
            F.array_join(F.transform("_lines", lambda x: x["line"]), "\n").alias("lines"),
        )
    )


def write_batches(batches: DataFrame, path: str) -> None:
    """Label, blank line and lines of every batch, in one folder per month."""
    batches.select(
        "folder", F.concat_ws("\n", "label", F.lit(""), "lines").alias("value")
    ).write.partitionBy("folder").text(path)
