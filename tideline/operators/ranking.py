"""Orders, ranks, samples and splits that give the same rows on every cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.staging import stage


def row_index(df: DataFrame, order: list[str], name: str = "i", start: int = 0) -> DataFrame:
    """Number of the row in the given total order, without bringing the table into one task.

    The table is range-partitioned and written; rows are numbered within ranges, and each range starts where the counts of the
    earlier ones end."""
    ranged = stage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_c"))
    starts = counts.select("_range", (F.sum("_c").over(Window.orderBy("_range")) - F.col("_c")).alias("_s"))  # one row a range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn(name, place).join(starts, "_range").withColumn(name, F.col(name) - 1 + F.col("_s") + start).drop("_range", "_s")


def running_sums(df: DataFrame, order: list[str], amounts: dict[str, str], descending: bool = False) -> DataFrame:
    """Adds, for each amount, its sum up to and with the row in the given total order; no task sees more than a range of the rows.

    The table is range-partitioned and written; a range starts with the totals of the ranges before it (one row a range)."""
    keys = [F.desc(c) if descending else F.col(c) for c in order]
    ranged = stage(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_range").agg(*[F.sum(a).alias(f"_t{i}") for i, a in enumerate(amounts)])
    over_ranges = Window.orderBy("_range")
    starts = totals.select("_range", *[(F.sum(f"_t{i}").over(over_ranges) - F.col(f"_t{i}")).alias(f"_s{i}") for i in range(len(amounts))])
    inside = Window.partitionBy("_range").orderBy(*keys)
    out = ranged
    for a, name in amounts.items():
        out = out.withColumn(name, F.sum(a).over(inside))
    out = out.join(starts, "_range")
    for i, name in enumerate(amounts.values()):
        out = out.withColumn(name, F.col(name) + F.col(f"_s{i}"))
    return out.drop("_range", *[f"_s{i}" for i in range(len(amounts))])


def hashed_order(key: str, seed: int | str = "") -> list[Column]:
    return [F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))), F.col(key)]


def hashed_sample(df: DataFrame, groups: list[str], key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows a group in the order of a seeded hash of the key."""
    k = F.row_number().over(Window.partitionBy(*groups).orderBy(*hashed_order(key, seed)))
    return df.withColumn("_k", k).where(F.col("_k") <= n).drop("_k")


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of the table: a bounded top-n by hash in each task, then of those."""
    return df.orderBy(*hashed_order(key, seed)).limit(n)


def folds(df: DataFrame, label: str, key: str, k: int) -> DataFrame:
    """Stratified folds 0 .. k-1 by hash order within labels; places within a label come from range partitions, so no label is one task."""
    order = [label, "_h", key]
    placed = row_index(df.withColumn("_h", F.md5(F.col(key).cast("string"))), order, "_i", 1)
    first = placed.groupBy(label).agg((F.min("_i") - 1).alias("_b"))
    return placed.join(first, placed[label].eqNullSafe(first[label])).drop(first[label]).withColumn("fold", ((F.col("_i") - F.col("_b")) % k).cast("bigint")).drop("_i", "_b", "_h")


def top_per_group(df: DataFrame, groups: list[str], order: list[Column | str], n: int, place: str = "place") -> DataFrame:
    """First ``n`` rows a group; Spark cuts each task's rows to ``n`` a group before the shuffle (WindowGroupLimit)."""
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(place) <= n)


def average_rank(value: str, *partition: str) -> Column:
    """Rank with ties averaged, divided by the number of rows, within small partitions; for large ones see `average_rank_by_counts`."""
    w = Window.partitionBy(*partition)
    return (F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*partition, value)) - 1) / 2) / F.count("*").over(w)


def average_rank_by_counts(df: DataFrame, value: str, name: str = "pct_rank", by: str | None = None) -> DataFrame:
    """The same over a whole table, or within groups of any size: ranks come from running counts of distinct values, joined back."""
    group = [by] if by else []
    c = running_sums(df.groupBy(*group, value).agg(F.count("*").alias("_c")), [*group, value], {"_c": "_t"})
    if by:
        size = c.groupBy(by).agg(F.min(F.col("_t") - F.col("_c")).alias("_b"), F.sum("_c").alias("_n"))
        c = c.join(size, by)
    else:
        c = c.withColumn("_b", F.lit(0)).join(F.broadcast(df.agg(F.count("*").alias("_n"))))
    r = c.select(*group, value, ((F.col("_t") - F.col("_b") - F.col("_c") + (F.col("_c") + 1) / 2) / F.col("_n")).alias(name))
    return df.join(r, [*group, value])


def best_by_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in the order."""
    return top_per_group(df, key, order, 1, "_p").drop("_p")


def time_split(df: DataFrame, at: str, train_until: str, test_from: str) -> DataFrame:
    """``part`` train before one time, test from another; what lies between (the gap against leakage) is left out."""
    t = F.col(at)
    part = F.when(t < F.lit(train_until).cast("timestamp_ntz"), "train").when(t >= F.lit(test_from).cast("timestamp_ntz"), "test")
    return df.withColumn("part", part).where("part is not null")
