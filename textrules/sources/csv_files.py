"""CSV in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textrules.functions.text import strip

_QUOTING = {"quote": '"', "escape": '"', "header": "false"}


def csv_source(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    delimiter: str = ",",
    header: bool = False,
    line_breaks: bool = True,
) -> DataFrame:
    """Typed columns by position; quoted fields may hold line breaks.

    ``header`` drops the first row of each file, whatever it says. A file whose fields may hold
    line breaks is read by one task; without ``line_breaks`` large files are split.
    """
    options = _QUOTING | {"header": str(header).lower(), "multiLine": str(line_breaks).lower()}
    return spark.read.options(**options, sep=delimiter, enforceSchema="true").csv(path, schema=schema)


def csv_sink(df: DataFrame, path: str, update: bool = False) -> None:
    """Write with every string stripped; an existing target is an error unless ``update``."""
    stripped = df.select(
        *[
            strip(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else f.name
            for f in df.schema.fields
        ]
    )
    stripped.write.mode("overwrite" if update else "errorifexists").options(**_QUOTING).csv(path)


def predictions_sink(predictions: DataFrame, path: str, label: str = "label") -> None:
    """One label per line."""
    csv_sink(predictions.select(label), path)
