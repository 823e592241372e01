"""Readers of files: delimited text, JSON lines, vectors, configurations. Schemas are given, not inferred, in production."""

from __future__ import annotations

import dataclasses
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideline.functions.time import parse_timestamp

T = TypeVar("T")


def delimited(spark: SparkSession, path: str, schema: StructType | str | None = None, sep: str = ",", timestamps: str = "yyyy-MM-dd HH:mm:ss", sample: float = 0.1) -> DataFrame:
    """CSV or TSV with a header. Without a schema types are inferred from a share of the rows; ``schema=""`` reads all strings."""
    r = spark.read.option("header", True).option("sep", sep).option("multiLine", False).option("quote", '"').option("escape", '"').option("timestampNTZFormat", timestamps).option("timestampFormat", timestamps)
    if schema:
        return r.schema(schema).csv(path)
    return r.csv(path) if schema == "" else r.option("inferSchema", True).option("samplingRatio", sample).csv(path)


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(good rows, broken lines as ``line``): a broken line never stops the read. Empty lines are neither."""
    s = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = StructType([*s.fields]).add("_broken", "string")
    read = spark.read.text(path).where("trim(value) != ''").select(F.col("value").alias("line"), F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))
    return read.where("r._broken is null").select(*[F.col(f"r.{f.name}").alias(f.name) for f in s.fields]), read.where("r._broken is not null").select("line")


NESTED_TWEET = """id_str string, created_at string, text string, lang string, retweet_count long, favorite_count long, extended_tweet struct<full_text: string>,
retweeted_status struct<id_str: string, text: string, extended_tweet: struct<full_text: string>, user: struct<id_str: string>>, quoted_status struct<id_str: string, text: string>,
entities struct<hashtags: array<struct<text: string>>, urls: array<struct<expanded_url: string>>, user_mentions: array<struct<screen_name: string>>>,
user struct<id_str: string, screen_name: string, followers_count: long, verified: boolean, location: string>"""


def flat_tweets(nested: DataFrame) -> DataFrame:
    """Nested tweets as one flat row: the longest text there is, lists joined by ``|``."""
    joined = lambda path, field: F.array_join(F.transform(path, lambda x: x[field]), "|")
    return nested.select(
        F.col("id_str").alias("tweet_id"), parse_timestamp(F.col("created_at")).alias("created_at"), F.coalesce("retweeted_status.extended_tweet.full_text", "extended_tweet.full_text", "retweeted_status.text", "text").alias("text"), "lang",
        F.coalesce("retweet_count", F.lit(0)).alias("retweet_count"), F.coalesce("favorite_count", F.lit(0)).alias("likes"), F.col("retweeted_status.id_str").isNotNull().alias("is_retweet"), F.col("retweeted_status.user.id_str").alias("retweeted_user_id"), F.col("quoted_status.id_str").alias("quoted_id"),
        joined("entities.hashtags", "text").alias("hashtags"), joined("entities.urls", "expanded_url").alias("urls"), joined("entities.user_mentions", "screen_name").alias("mentions"), F.col("user.id_str").alias("user_id"), F.col("user.screen_name").alias("user_screen_name"), F.col("user.followers_count").alias("user_followers_count"), F.col("user.verified").alias("user_verified"), F.col("user.location").alias("user_location"),
    )


def result_bands(results: DataFrame, answer: str, score: str, high: float = 0.7, low: float = 0.3) -> DataFrame:
    """Result rows without errors, with a band of their score."""
    ok = results.where(~F.coalesce(F.col(answer), F.lit("ERROR:")).rlike("^(ERROR|TIMEOUT):?"))
    return ok.withColumn("band", F.when(F.col(score) >= high, "good").when(F.col(score) <= low, "bad").otherwise("middle"))


def ensure_columns(df: DataFrame, schema: StructType | str) -> DataFrame:
    """Exactly the columns of the schema: missing ones as typed nulls, others cast, extra ones dropped."""
    s = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in s.fields])


def first_of(df: DataFrame, *names: str):
    """The first non-null of the columns that exist."""
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None)


def largest_file(spark: SparkSession, folder: str) -> DataFrame:
    """The file of a folder with most rows (ties: first by name); counted from footers by the scan, one row a file."""
    counts = spark.read.parquet(folder).select(F.input_file_name().alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    best = counts.orderBy(F.desc("n"), "f").limit(1).collect()
    return spark.read.parquet(best[0].f) if best else spark.read.parquet(folder)


def merged_parts(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """Checkpointed parts of a table as one, a row a key."""
    return spark.read.parquet(folder).dropDuplicates([key])


def vectors_from_npy(spark: SparkSession, path: str, key: str = "vec_id") -> DataFrame:
    """A NumPy matrix file as rows of (``vec_id``, ``embedding``); memory-mapped and cut into blocks on the driver's machine only to be written."""
    import numpy as np

    m = np.load(path, mmap_mode="r", allow_pickle=False)
    blocks = [(i, m[i : i + 10_000].astype("float32")) for i in range(0, len(m), 10_000)]
    out = None
    for start, b in blocks:
        part = spark.createDataFrame([(start + j, v.tolist()) for j, v in enumerate(b)], f"{key} long, embedding array<float>")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"{key} long, embedding array<float>")


def config_from(cls: type[T], values: dict[str, Any]) -> T:
    """A dataclass from a mapping; names it doesn't know are ignored."""
    known = {f.name for f in dataclasses.fields(cls)}
    return cls(**{k: v for k, v in values.items() if k in known})


@dataclasses.dataclass
class PipelineConfig:
    """Settings of the detection pipeline with their defaults."""

    window_size: str = "1h"
    similarity_threshold: float = 0.75
    claim_threshold: float = 0.85
    min_words: int = 4
    max_words: int = 150
    zscore_threshold: float = 2.0
    min_count: int = 10
    mature_windows: int = 24
    limit: int | None = None
