"""Anomaly scores over time series: rolling, expanding and shrunk z-scores, burst states, the ensemble of them.

A series is long: (entity, time, value). Frames count rows, not time, as only active windows are rows. Windows are partitioned
by entity, so no entity's history leaves its task and no task needs another's."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series(df: DataFrame, entity: str, at: str, unit: str, value: Column | None = None) -> DataFrame:
    """``entity, t, n``: counts (or sums of ``value``) per entity and calendar bucket."""
    t = F.date_trunc(unit, at).cast("timestamp_ntz")
    return df.where(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("entity"), t.alias("t")).agg((F.count("*") if value is None else F.sum(value)).alias("n"))


def resample(s: DataFrame, unit: str) -> DataFrame:
    return s.groupBy("entity", F.date_trunc(unit, "t").cast("timestamp_ntz").alias("t")).agg(F.sum("n").alias("n"))


def rolling_z(s: DataFrame, width: int, least_count: float = 10, least_std: float = 2.0, threshold: float | None = 3.0) -> DataFrame:
    """z against the previous ``width`` rows (population deviation); rows without a full baseline, with a small count or a flat
    baseline are left out; with a threshold only rows strictly above it stay."""
    w = Window.partitionBy("entity").orderBy("t").rowsBetween(-width, -1)
    d = s.select("*", F.avg("n").over(w).alias("mean"), F.stddev_pop("n").over(w).alias("std"), F.count("n").over(w).alias("k"))
    d = d.where((F.col("k") == width) & (F.col("n") >= least_count) & (F.round("std", 9) >= least_std))
    z = (F.col("n") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0))
    d = d.select("entity", "t", "n", F.round(z, 6).alias("z"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))
    return d if threshold is None else d.where(F.col("z") > threshold)


def expanding_z(s: DataFrame, start: int, least_count: float = 10, least_std: float = 2.0, threshold: float | None = 3.0) -> DataFrame:
    """z against all earlier rows of the entity, from row ``start`` on."""
    w = Window.partitionBy("entity").orderBy("t")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = s.select("*", F.avg("n").over(before).alias("mean"), F.stddev_pop("n").over(before).alias("std"), F.row_number().over(w).alias("k"))
    d = d.where((F.col("k") > start) & (F.col("n") >= least_count) & (F.round("std", 9) >= least_std))
    z = (F.col("n") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0))
    d = d.select("entity", "t", "n", F.round(z, 6).alias("z"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))
    return d if threshold is None else d.where(F.col("z") > threshold)


def all_levels(hourly: DataFrame, least_count: float = 10, least_std: float = 2.0, threshold: float | None = 3.0) -> DataFrame:
    """The four granularities: hour/24, hour/168, day/30, week/all earlier from the fourth on."""
    daily, weekly = resample(hourly, "day"), resample(hourly, "week")
    g = dict(least_count=least_count, least_std=least_std, threshold=threshold)
    parts = [("hourly_24", rolling_z(hourly, 24, **g)), ("hourly_168", rolling_z(hourly, 168, **g)), ("daily_30", rolling_z(daily, 30, **g)), ("weekly_global", expanding_z(weekly, 4, **g))]
    out = None
    for name, p in parts:
        p = p.withColumn("level", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out


def heat_z(s: DataFrame, warm: int = 24, width: int = 168) -> DataFrame:
    """z for display: 0 for the first ``warm`` rows and for flat baselines, else against at most ``width`` rows before."""
    w = Window.partitionBy("entity").orderBy("t")
    f = w.rowsBetween(-width, -1)
    m, d = F.avg("n").over(f), F.stddev_pop("n").over(f)
    z = F.when((F.row_number().over(w) <= warm) | (d == 0), 0.0).otherwise((F.col("n") - m) / F.nullif(d, F.lit(0.0)))
    return s.select("entity", "t", "n", F.round(z, 6).alias("z"))


def partition_z(df: DataFrame, entity: str, value: str, name: str) -> DataFrame:
    """z over all of an entity's rows with the sample deviation; 0 where it is 0 or undefined.

    Statistics are aggregated (partially, before the shuffle) and joined back: cheaper than a window over a hot entity."""
    stats = df.groupBy(entity).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    z = F.when(F.col("_s").isNull() | (F.col("_s") == 0) | F.isnan("_s"), 0.0).otherwise((F.col(value) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0)))
    return df.join(stats, entity).withColumn(name, F.round(z, 6)).drop("_m", "_s")


MATURE, ROLL = 24, 168


def active_stats(s: DataFrame) -> DataFrame:
    """Trailing statistics of each row over at most 168 earlier active rows; mean and deviation 0 below two."""
    w = Window.partitionBy("entity").orderBy("t").rowsBetween(-ROLL, -1)
    k = F.count("n").over(w)
    return s.select("*", k.alias("obs"), F.when(k < 2, 0.0).otherwise(F.avg("n").over(w)).alias("mean"), F.when(k < 2, 0.0).otherwise(F.stddev_pop("n").over(w)).alias("std"))


def global_running(stats: DataFrame) -> DataFrame:
    """Mean and sample deviation over all sparse rows up to and with the row, in order of (t, entity).

    Running totals in two levels: totals of each time are aggregated first, so the only window without partition has one row a
    time; within a time the rows are few (one an entity)."""
    sparse = stats.where(F.col("obs") < MATURE)
    x = F.col("n").cast("double")
    per = sparse.groupBy("t").agg(F.count("*").alias("c"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    earlier = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("t", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias("b" + k) for k in ("c", "s", "q")])
    inside = Window.partitionBy("t").orderBy("entity").rowsBetween(Window.unboundedPreceding, 0)
    j = sparse.join(base, "t")
    c, sm, q = F.count("*").over(inside) + F.col("bc"), F.sum(x).over(inside) + F.col("bs"), F.sum(x * x).over(inside) + F.col("bq")
    out = j.select("entity", "t", "n", "obs", "mean", "std", c.alias("g"), sm.alias("gs"), q.alias("gq"))
    mean = F.col("gs") / F.col("g")
    var = F.when(F.col("g") < 2, 0.0).otherwise(F.greatest((F.col("gq") - F.col("g") * mean * mean) / F.greatest(F.col("g") - 1, F.lit(1)), F.lit(0.0)))
    return out.select("entity", "t", "n", "obs", "mean", "std", "g", mean.alias("g_mean"), F.sqrt(var).alias("g_std"))


def shrunk_z(stats: DataFrame, prior: float = 24.0, least_global: int = 100) -> DataFrame:
    """Empirical-Bayes score of sparse rows: trailing statistics mixed with global ones by n / (prior + n)."""
    g = global_running(stats)
    w = F.col("obs") / (F.col("obs") + prior)
    mean = w * F.col("mean") + (1 - w) * F.col("g_mean")
    std = F.greatest(F.when(F.col("obs") < 3, F.col("g_std")).otherwise(F.greatest(w * F.col("std") + (1 - w) * F.col("g_std"), 0.5 * F.col("g_std"))), F.lit(1.0))
    return g.where(F.col("g") >= least_global).select("entity", "t", "n", "obs", F.round(w, 6).alias("weight"), F.round((F.col("n") - mean) / std, 6).alias("z"))


def burst_states(stats: DataFrame, ratio: float = 2.0, gamma: float = 1.0, levels: int = 3, rows: Column | None = None) -> DataFrame:
    """State of a burst automaton for every mature row (or those that ``rows`` picks): ``levels`` Poisson rates base * ratio^s, raising costs
    gamma a level, falling is free, ties go to the lower state.

    One fold over rows in order: a partition's rows come sorted by entity and time in Arrow batches, what each previous state leads to is
    worked out for a batch at once, and only the state is carried on, also from batch to batch. No series is gathered."""
    kind = stats.schema["entity"].dataType
    picked = stats.where(F.col("obs") >= MATURE if rows is None else rows).select("entity", "t", F.col("n").cast("long").alias("n"), F.greatest("mean", F.lit(1.0)).cast("double").alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity, state = None, 0
        for batch in batches:
            n, r = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            rate = r[:, None] * ratio ** np.arange(levels)[None, :]
            fit = n[:, None] * np.log(rate) - rate
            raised = gamma * np.maximum(np.arange(levels)[None, :] - np.arange(levels)[:, None], 0)  # [from, to]
            to = (fit[:, None, :] - raised[None, :, :]).argmax(2).tolist()
            out = []
            for e, leads in zip(batch.column(0).to_pylist(), to):
                if e != entity:
                    entity, state = e, 0
                state = leads[state]
                out.append(state)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.int32())], ["entity", "t", "n", "state"])

    return picked.repartition("entity").sortWithinPartitions("entity", "t").mapInArrow(run, f"entity {kind.simpleString()}, t timestamp_ntz, n bigint, state int")


def burst_by_brute_force(values: list[tuple[float, float]], ratio: float = 2.0, gamma: float = 1.0, levels: int = 3) -> list[int]:
    """States of (n, base rate) pairs by a plain loop; for tests."""
    out, state = [], 0
    for n, r in values:
        scores = [n * math.log(max(r, 1.0) * ratio**s) - max(r, 1.0) * ratio**s - gamma * max(0, s - state) for s in range(levels)]
        state = max(range(levels), key=lambda s: (scores[s], -s))
        out.append(state)
    return out


def engagement_series(df: DataFrame, entity: str, at: str, unit: str, engagement: Column) -> DataFrame:
    """``entity, t, n, e``: posts and engagement per entity and calendar bucket."""
    t = F.date_trunc(unit, at).cast("timestamp_ntz")
    return df.where(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("entity"), t.alias("t")).agg(F.count("*").alias("n"), F.coalesce(F.sum(engagement), F.lit(0)).cast("long").alias("e"))


def both_stats(s: DataFrame) -> DataFrame:
    """`active_stats` of counts (``mean``, ``std``) and of engagement (``mean_e``, ``std_e``)."""
    w = Window.partitionBy("entity").orderBy("t").rowsBetween(-ROLL, -1)
    k = F.count("n").over(w)
    of = lambda f, c: F.when(k < 2, 0.0).otherwise(f(c).over(w))
    return s.select("*", k.alias("obs"), of(F.avg, "n").alias("mean"), of(F.stddev_pop, "n").alias("std"), of(F.avg, "e").alias("mean_e"), of(F.stddev_pop, "e").alias("std_e"))


def cold_scores(stats: DataFrame, prior: float = 24.0, least_global: int = 100, least_count: int = 5, least_engagement: int = 20, weight: float = 0.4) -> DataFrame:
    """Empirical-Bayes scores of sparse rows with enough activity, once enough rows were seen: ``z_count``, ``z_engagement``, ``z``."""
    own = ["entity", "t", "obs", "n", "mean", "std"]
    counts = shrunk_z(stats.select(*own), prior, least_global).select("entity", "t", F.col("z").alias("z_count"))
    of_e = stats.select("entity", "t", "obs", F.col("e").alias("n"), F.col("mean_e").alias("mean"), F.col("std_e").alias("std"))
    engagement = shrunk_z(of_e, prior, least_global).select("entity", "t", F.col("z").alias("z_engagement"))
    active = stats.where((F.col("obs") < MATURE) & (F.col("n") >= least_count) & (F.col("e") >= least_engagement)).select("entity", "t")
    both = active.join(counts, ["entity", "t"]).join(engagement, ["entity", "t"])
    return both.withColumn("z", F.round(weight * F.col("z_count") + (1 - weight) * F.col("z_engagement"), 6))


def detections(s: DataFrame, compute_all: bool = True, bayesian: bool = True, z_at: float = 3.0, state_at: int = 2, least_count: int = 10, least_engagement: int = 50, least_std: float = 2.0, least_std_e: float = 5.0, weight: float = 0.4) -> DataFrame:
    """Scores of counts and engagement (``s``: `engagement_series`), their mixture, burst state and what triggered, for every row of every entity.

    Sparse rows (under ``MATURE`` earlier ones) are scored by `cold_scores` where ``bayesian`` is set. Otherwise, with ``compute_all``, they
    are scored against what there is with relaxed deviations but trigger nothing; without it they have no score at all, nor have rows
    below the activity thresholds, and the burst automaton doesn't see either."""
    stats = both_stats(s)
    sparse, active = F.col("obs") < MATURE, (F.col("n") >= least_count) & (F.col("e") >= least_engagement)
    seen = ~sparse if bayesian else F.lit(True)
    if not compute_all:
        seen = ~sparse & active
    z = lambda x, m, d, least: F.when(F.col(d) < F.when(sparse, 0.1).otherwise(least), 0.0).otherwise((F.col(x) - F.col(m)) / F.nullif(F.col(d), F.lit(0.0)))
    zc, ze = z("n", "mean", "std", least_std), z("e", "mean_e", "std_e", least_std_e)
    scored = stats.where(seen).select("entity", "t", F.round(zc, 6).alias("z_count"), F.round(ze, 6).alias("z_engagement"), F.round(weight * zc + (1 - weight) * ze, 6).alias("z"))
    scored = scored.join(burst_states(stats, rows=seen).select("entity", "t", "state"), ["entity", "t"])
    if bayesian:
        scored = scored.unionByName(cold_scores(stats, weight=weight).withColumn("state", F.lit(0)))
    d = stats.select("entity", "t", "n", "e", "obs").join(scored, ["entity", "t"], "left")
    hit_z, hit_k = F.col("z") > z_at, F.col("state") >= state_at
    warm = F.when(sparse | ~active, "none").when(hit_z & hit_k, "both").when(hit_z, "zscore").when(hit_k, "kleinberg").otherwise("none")
    trigger = F.when(sparse & hit_z, "bayesian_cold_start").otherwise(warm) if bayesian else warm
    return d.select("entity", "t", "n", "e", F.when(sparse, "sparse").otherwise("mature").alias("path"), "z_count", "z_engagement", "z", "state", trigger.alias("trigger"))


def ensemble(s: DataFrame, z_at: float = 2.0, shrunk_at: float = 2.0, least_count: int = 10, least_std: float = 1.0) -> DataFrame:
    """Every active row with the score of its path: sparse rows the shrunk z, mature rows z and burst state; ``trigger`` names what fired.

    A row without a score of its own carries the entity's last one forward."""
    stats = active_stats(s)
    mature = stats.where(F.col("obs") >= MATURE)
    z = F.when(F.col("std") < least_std, 0.0).otherwise((F.col("n") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0)))
    states = burst_states(stats).select("entity", "t", "state")
    a = mature.select("entity", "t", "n", F.round(z, 6).alias("score"), F.lit("mature").alias("path")).join(states, ["entity", "t"], "left")
    sparse = stats.where(F.col("obs") < MATURE).select("entity", "t", "n").join(shrunk_z(stats).select("entity", "t", F.col("z").alias("score")), ["entity", "t"], "left")
    b = sparse.select("entity", "t", "n", "score", F.lit("sparse").alias("path"), F.lit(0).alias("state"))
    both = a.unionByName(b)
    last = F.last("score", ignorenulls=True).over(Window.partitionBy("entity").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    fires = F.col("n") >= least_count
    hit_z, hit_k = fires & (F.col("score") > z_at), fires & (F.col("state") >= 1)
    trigger = F.when((F.col("path") == "sparse") & fires & (F.col("score") > shrunk_at), "bayesian").when(F.col("path") == "sparse", "none").when(hit_z & hit_k, "both").when(hit_z, "zscore").when(hit_k, "kleinberg").otherwise("none")
    return both.select("entity", "t", "n", "path", F.round(last, 6).alias("score"), F.coalesce("state", F.lit(0)).alias("state"), trigger.alias("trigger"))
