"""Tables of a data folder, one Parquet file or folder of files each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet`` as a DataFrame; nothing is read until an action needs it, and then only the columns used."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
