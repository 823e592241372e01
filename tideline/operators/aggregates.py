"""Aggregations: profiles, shares, entropy, inequality, votes. All are one or two levels of partial aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: non-null values, kinds, extremes; strings are measured in bytes. One pass over the table for all."""
    kinds = dict(df.dtypes)

    def value(c: str) -> Column:
        return F.octet_length(c) if kinds[c] == "string" else F.col(c)

    aggs = [a for i, c in enumerate(columns) for a in (F.count(c).alias(f"n{i}"), F.count_distinct(c).alias(f"k{i}"), F.min(value(c)).cast("string").alias(f"l{i}"), F.max(value(c)).cast("string").alias(f"h{i}"))]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"n{i}").alias("n"), F.col(f"k{i}").alias("kinds"), F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high")) for i, c in enumerate(columns)])
    return one.select(F.inline(rows))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("nulls")) for c in columns])
    return one.select("_n", F.inline(rows)).select("name", "nulls", F.round(100.0 * F.col("nulls") / F.col("_n"), 6).alias("pct"))


def split_share(df: DataFrame, group: str, split: str, over: float = 3.0) -> DataFrame:
    """Share of each split within a group, and relative to the split's size; flags groups over-represented ``over`` times."""
    c = df.groupBy(group, split).agg(F.count("*").alias("n"))
    t = c.groupBy(split).agg(F.sum("n").alias("_s"))
    g = c.groupBy(group).agg(F.sum("n").alias("_g"))
    a = c.agg(F.sum("n").alias("_a"))
    j = c.join(t, split).join(g, group).join(F.broadcast(a))
    lift = (F.col("n") / F.col("_s")) / (F.col("_g") / F.col("_a"))
    return j.select(group, split, "n", F.round(100.0 * F.col("n") / F.col("_g"), 6).alias("raw_pct"), F.round(lift, 6).alias("lift"), (F.col("n") / F.col("_s") > over * (F.col("_g") / F.col("_a"))).alias("over"))


def entropy(df: DataFrame, group: str, category: str, base: float = 2.0) -> DataFrame:
    """Shannon entropy of categories within groups; 0 for one category; nulls don't count."""
    c = df.where(F.col(category).isNotNull()).groupBy(group, category).agg(F.count("*").alias("_c"))
    # -sum(p log p) = log(n) - sum(c log c) / n, so the counts are aggregated once and no total is joined back
    n = F.sum("_c")
    return c.groupBy(group).agg(F.round(F.greatest((F.log(n) - F.sum(F.col("_c") * F.log("_c")) / n) / F.log(F.lit(base)), F.lit(0.0)), 6).alias("entropy"), F.count("*").alias("categories"))


def one_vote(df: DataFrame, group: str, user: str, value: str) -> DataFrame:
    """Mean in which every user has one vote: mean and population deviation of the users' own means."""
    u = df.where(F.col(user).isNotNull() & F.col(value).isNotNull()).groupBy(group, user).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count("*").alias("n"))
    return u.groupBy(group).agg(F.round(F.sum("s") / F.sum("n"), 6).alias("naive_mean"), F.round(F.avg("m"), 6).alias("vote_mean"), F.round(F.stddev_pop("m"), 6).alias("vote_std"), F.round(F.sum("n") / F.count("*"), 6).alias("per_user"))


def gini(df: DataFrame, group: str, value: str) -> DataFrame:
    """Gini coefficient of values of at least 0 within groups; 0 where all are 0.

    Works on counts of equal values, so a group of millions of rows is sorted by its distinct values only."""
    c = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("_v")).agg(F.count("*").cast("double").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(group).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    c = c.withColumn("_b", before)
    # ranks b+1 .. b+c of the c equal values sum to c * b + c (c + 1) / 2
    weighted = F.sum(F.col("_v") * (F.col("_c") * F.col("_b") + F.col("_c") * (F.col("_c") + 1) / 2))
    n, total = F.sum("_c"), F.sum(F.col("_v") * F.col("_c"))
    return c.groupBy(group).agg(F.round(F.when(total == 0, 0.0).otherwise((2 * weighted - (n + 1) * total) / (n * F.nullif(total, F.lit(0.0)))), 6).alias("gini"))


def size_bands(df: DataFrame, group: str, edges: tuple[int, ...] = (1, 2, 5, 10, 50)) -> DataFrame:
    """Number, mean, median, extremes of group sizes and how many lie in the bands 1, 2, 3-5, 6-10, 11-50, over 50."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    n, low = F.col("n"), 0
    bands = []
    for e in edges:
        bands.append(F.count_if((n > low) & (n <= e)).alias(f"upto_{e}"))
        low = e
    return sizes.agg(F.count("*").alias("groups"), F.round(F.avg(n), 6).alias("mean"), F.median(n).alias("median"), F.min(n).alias("low"), F.max(n).alias("high"), *bands, F.count_if(n > low).alias("over"))


def sum_across(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns])
