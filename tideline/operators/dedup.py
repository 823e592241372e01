"""Duplicates by row, key and text, and near-duplicates by word sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.ranking import best_by_key


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def highest_by_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row a key, the highest in the order."""
    return best_by_key(df, [key], order)


def text_key(c: Column) -> Column:
    """Hash of a text without case and outer spaces."""
    return F.sha2(F.lower(F.trim(c)), 256)


def occurrence(df: DataFrame, key: Column, order: list[str], name: str = "occurrence") -> DataFrame:
    """Running number of a row among rows with an equal key."""
    return df.withColumn("_k", key).withColumn(name, F.row_number().over(Window.partitionBy("_k").orderBy(*order))).drop("_k")


def jaccard_links(df: DataFrame, key: str, words: str, least: float) -> DataFrame:
    """Pairs of keys whose word sets overlap by ``least`` or more, through an inverted index on rare words.

    Each row is indexed under its ``n - ceil(least n) + 1`` rarest words: two similar rows always share one of those, so no
    pair is lost, and frequent words, which would make long lists, are rarely among them. Equal word sets are one entry."""
    rows = df.select(F.col(key).alias("k"), F.array_sort(F.array_distinct(words)).alias("w")).where(F.size("w") > 0)
    sets = rows.groupBy(F.xxhash64("w").alias("id")).agg(F.first("w").alias("w"))
    counts = sets.select(F.explode("w").alias("t")).groupBy("t").agg(F.count("*").alias("c"))
    listed = sets.select("id", F.size("w").alias("n"), F.explode("w").alias("t")).join(counts, "t")
    keep = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1
    place = F.row_number().over(Window.partitionBy("id").orderBy("c", "t"))
    index = listed.withColumn("p", place).where(F.col("p") <= keep).select("id", "n", "t")
    a, b = index.withColumnsRenamed({"id": "a", "n": "na"}), index.withColumnsRenamed({"id": "b", "n": "nb"})
    pairs = a.join(b, "t").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9)).select("a", "b").distinct()
    both = pairs.join(sets.withColumnsRenamed({"id": "a", "w": "wa"}), "a").join(sets.withColumnsRenamed({"id": "b", "w": "wb"}), "b")
    share = F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb"))
    links = both.withColumn("similarity", share).where(F.col("similarity") >= least - 1e-12).select("a", "b", "similarity")
    members = rows.select(F.xxhash64("w").alias("id"), "k")
    across = links.join(members.withColumnsRenamed({"id": "a", "k": "ka"}), "a").join(members.withColumnsRenamed({"id": "b", "k": "kb"}), "b").select("ka", "kb", "similarity")
    same = members.join(members.withColumnRenamed("k", "k2"), "id").where("k < k2").select(F.col("k").alias("ka"), F.col("k2").alias("kb"), F.lit(1.0).alias("similarity"))
    out = across.unionByName(same)
    return out.where("ka != kb").select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"), F.round("similarity", 6).alias("similarity")).distinct()


def prefix_length(n: int, least: float) -> int:
    return n - math.ceil(least * n - 1e-9) + 1
