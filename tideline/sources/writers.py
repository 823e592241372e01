"""Writers: Parquet with chosen compression and row groups, CSV, JSON, and the star schema in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, by: list[str] | None = None, rows_a_file: int | None = None, mode: str = "errorifexists") -> None:
    """Compressed Parquet; partition columns and the largest number of rows a file may be given."""
    w = df.write.mode(mode).option("compression", "zstd")
    if rows_a_file:
        w = w.option("maxRecordsPerFile", rows_a_file)
    (w.partitionBy(*by) if by else w).parquet(path)


def csv(df: DataFrame, path: str, mode: str = "errorifexists", sep: str = ",") -> None:
    """With a header; quotes doubled, outer spaces kept."""
    df.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def star_schema(relations: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    """Every relation to its own folder; ``tweets`` by day."""
    for name, df in relations.items():
        if name == "tweets" and "created_at" in df.columns:
            parquet(df.withColumn("date", F.to_date("created_at")), f"{folder}/{name}", ["date"], mode=mode)
        else:
            parquet(df, f"{folder}/{name}", mode=mode)


def chronological_subset(df: DataFrame, at: str, key: str, n: int) -> DataFrame:
    return df.orderBy(at, key).limit(n)
