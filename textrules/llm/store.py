"""Tables in the folder that ``spark.checkpoint.dir`` names, which driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from textrules.session import new_folder, written


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it back: computed once, and no lost executor loses it."""
    return written(df, name)


def folder(df: DataFrame, name: str) -> str:
    """A new path in the shared folder."""
    return new_folder(df.sparkSession, name)
