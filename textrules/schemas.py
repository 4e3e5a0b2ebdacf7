"""Typed schemas of the logical tables and the job that creates them empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_INT, _LONG, _STR, _TS = T.IntegerType(), T.LongType(), T.StringType(), T.TimestampType()


def _table(*columns: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in columns])


TABLES: dict[str, T.StructType] = {
    "topics": _table(("topic_id", _INT, False), ("name", _STR, True)),
    "sources": _table(("source_id", _INT, False), ("name", _STR, True)),
    "words": _table(("word_id", _LONG, False), ("word", _STR, False)),
    "posts": _table(
        ("post_id", _LONG, False), ("topic_id", _INT, True), ("source_id", _INT, True),
        ("title", _STR, True), ("url", _STR, True), ("ts", _TS, True),
    ),
    "sentences": _table(
        ("post_id", _LONG, False), ("sentence_seq", _INT, False), ("full_text", _STR, True)
    ),
    "sentence_words": _table(
        ("post_id", _LONG, False), ("sentence_seq", _INT, False), ("word_seq", _INT, False),
        ("word_id", _LONG, False),
    ),
    "rulesets": _table(
        ("topic_id", _INT, False), ("category_seq", _INT, False), ("name", _STR, True)
    ),
    "rules": _table(
        ("rule_id", _LONG, False), ("topic_id", _INT, True), ("category_seq", _INT, True),
        ("full_text", _STR, True),
    ),
    "rule_words": _table(
        ("rule_id", _LONG, False), ("word_seq", _INT, False), ("word_id", _LONG, False)
    ),
    "matches": _table(
        ("rule_id", _LONG, False), ("post_id", _LONG, False), ("sentence_seq", _INT, False)
    ),
    "rule_watermark": _table(("rule_id", _LONG, False), ("last_post_id", _LONG, False)),
}


def create_tables(spark: SparkSession, folder: str | None = None) -> dict[str, DataFrame]:
    """Every logical table, empty and typed; with ``folder`` also written there as Parquet."""
    empty = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}
    if folder is not None:
        for name, table in empty.items():
            table.write.mode("overwrite").parquet(f"{folder}/{name}")
    return empty
