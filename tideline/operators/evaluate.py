"""Evaluation: confusion counts, calibration, curves, tests, intervals, drift. Scores travel as columns, counts as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.ranking import running_sums

from tideline.functions import maths as M


def _share(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))


def confusion(df: DataFrame, truth: str, said: str, groups: list[str] | None = None) -> DataFrame:
    """Counts, accuracy, precision, recall, F1 and F2 of boolean columns; 0 where a denominator is empty."""
    t, p = F.col(truth), F.col(said)
    c = df.where(t.isNotNull() & p.isNotNull()).groupBy(*(groups or [])).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    precision, recall = _share(tp, tp + fp), _share(tp, tp + fn)
    r = lambda x: F.round(x, 6)
    return c.select(*(groups or []), "tp", "fp", "fn", "tn", r(_share(tp + tn, tp + fp + fn + tn)).alias("accuracy"), r(precision).alias("precision"), r(recall).alias("recall"), r(_share(2 * tp, 2 * tp + fp + fn)).alias("f1"), r(_share(5 * tp, 5 * tp + 4 * fn + fp)).alias("f2"))


def bins_for(n: int) -> int:
    return max(3, min(10, math.isqrt(n)))


def calibration_error(df: DataFrame, p: str, hit: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins of probability, and the Brier score."""
    rows = df.where(F.col(p).isNotNull() & F.col(hit).isNotNull()).select(F.round(p, 6).alias("p"), F.col(hit).cast("int").alias("y"))
    b = rows.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("n"), F.avg("p").alias("conf"), F.avg("y").alias("acc"), F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("sq"))
    return b.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n"), 6).alias("ece"), F.round(F.sum("sq") / F.sum("n"), 6).alias("brier"))


def threshold_sweep(df: DataFrame, p: str, truth: str, thresholds: list[float]) -> DataFrame:
    """F1 at every threshold in one pass: one conditional count a threshold, no row is copied."""
    t, s = F.col(truth), F.col(p)
    rows = df.where(t.isNotNull() & s.isNotNull())
    one = rows.agg(F.count_if(t).alias("pos"), *[x for i, v in enumerate(thresholds) for x in (F.count_if(t & (s >= v)).alias(f"tp{i}"), F.count_if(s >= v).alias(f"pp{i}"))])
    out = F.array(*[F.struct(F.lit(v).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"pp{i}").alias("flagged"), F.round(_share(2.0 * F.col(f"tp{i}"), (F.col("pos") + F.col(f"pp{i}")).cast("double")), 6).alias("f1")) for i, v in enumerate(thresholds)])
    return one.select(F.inline(out))


def curve_optimum(df: DataFrame, p: str, truth: str) -> DataFrame:
    """Threshold with the highest F1 over all scores, from counts of distinct scores."""
    c = df.where(F.col(p).isNotNull() & F.col(truth).isNotNull()).groupBy(F.col(p).alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col(truth)).alias("k"))
    total = c.agg(F.sum("k").alias("pos"))
    run = running_sums(c, ["s"], {"n": "pp", "k": "tp"}, descending=True).join(F.broadcast(total))
    f1 = F.round(_share(2.0 * F.col("tp"), (F.col("pos") + F.col("pp")).cast("double")), 6)
    return run.select(F.col("s").alias("threshold"), f1.alias("f1")).orderBy(F.desc("f1"), F.desc("threshold")).limit(1)


def mcnemar(df: DataFrame, a: str, b: str) -> DataFrame:
    """Discordant counts of two boolean columns, statistic with continuity correction, odds ratio."""
    c = df.agg(F.count_if(~F.col(a) & F.col(b)).alias("b01"), F.count_if(F.col(a) & ~F.col(b)).alias("b10"))
    x, y = F.col("b01"), F.col("b10")
    d = F.greatest(F.abs(x - y) - 1, F.lit(0))
    return c.select("b01", "b10", F.round(_share((d * d).cast("double"), (x + y).cast("double")), 6).alias("chi2"), F.round(_share(x.cast("double"), y.cast("double")), 6).alias("odds"))


def chi2_p(x: float) -> float:
    """P of a chi-square statistic with one degree of freedom."""
    return math.erfc(math.sqrt(max(0.0, x) / 2))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence of two categorical columns: statistic and degrees of freedom, from the contingency counts."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("o"))
    rows, cols = c.groupBy(a).agg(F.sum("o").alias("_r")), c.groupBy(b).agg(F.sum("o").alias("_c"))
    # sum (o-e)^2/e over all cells = sum o^2/e - n, so empty cells needn't be made
    n = c.agg(F.sum("o").cast("double").alias("_n"), F.count_distinct(a).alias("_ra"), F.count_distinct(b).alias("_cb"))
    j = c.join(rows, a).join(cols, b).join(F.broadcast(n))
    return j.groupBy("_n", "_ra", "_cb").agg(F.sum(F.col("o") * F.col("o") * F.col("_n") / (F.col("_r") * F.col("_c"))).alias("s")).select(F.round(F.col("s") - F.col("_n"), 6).alias("chi2"), ((F.col("_ra") - 1) * (F.col("_cb") - 1)).alias("dof"))


def adjusted(df: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """Holm, Bonferroni and Benjamini-Hochberg thresholds and decisions of a (small) table of tests."""
    m = F.count("*").over(Window.partitionBy())
    k = F.row_number().over(Window.orderBy(p))
    d = df.withColumn("_k", k).withColumn("_m", m)
    d = d.withColumn("holm", F.round(alpha / (F.col("_m") - F.col("_k") + 1), 6)).withColumn("bonferroni", F.round(alpha / F.col("_m"), 6)).withColumn("bh", F.round(alpha * F.col("_k") / F.col("_m"), 6))
    ok = F.when(F.col(p) <= alpha / (F.col("_m") - F.col("_k") + 1), 1).otherwise(0)
    d = d.withColumn("holm_significant", F.min(ok).over(Window.orderBy("_k")) == 1)
    last = F.max(F.when(F.col(p) <= alpha * F.col("_k") / F.col("_m"), F.col("_k"))).over(Window.partitionBy())
    return d.withColumn("bh_significant", F.coalesce(F.col("_k") <= last, F.lit(False))).drop("_k", "_m")


def ranking_metrics(df: DataFrame, query: str, score: str, relevant: str, item: str, cuts: tuple[int, ...] = (1, 5, 10, 20, 30)) -> DataFrame:
    """Mean average precision, mean reciprocal rank and precision at cuts over queries."""
    w = Window.partitionBy(query).orderBy(F.desc(score), item)
    r = df.withColumn("_k", F.row_number().over(w)).withColumn("_h", F.sum(F.col(relevant).cast("int")).over(w))
    rel = F.col(relevant)
    per = r.groupBy(query).agg(
        F.coalesce(F.avg(F.when(rel, F.col("_h") / F.col("_k"))), F.lit(0.0)).alias("ap"), F.coalesce(1.0 / F.min(F.when(rel, F.col("_k"))), F.lit(0.0)).alias("rr"), *[(F.count_if(rel & (F.col("_k") <= c)) / F.lit(float(c))).alias(f"p{c}") for c in cuts]
    )
    return per.agg(F.round(F.avg("ap"), 6).alias("map"), F.round(F.avg("rr"), 6).alias("mrr"), *[F.round(F.avg(f"p{c}"), 6).alias(f"p_at_{c}") for c in cuts])


def ks_statistic(df: DataFrame, value: str, side: str) -> DataFrame:
    """Largest distance of the two sides' distribution functions; ``side`` is boolean. Over counts of distinct values."""
    c = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(F.col(side)).alias("a"), F.count_if(~F.col(side)).alias("b"))
    n = c.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    j = running_sums(c, [value], {"a": "ca", "b": "cb"}).join(F.broadcast(n))
    return j.agg(F.round(F.max(F.abs(F.col("ca") / F.greatest(F.col("na"), F.lit(1)) - F.col("cb") / F.greatest(F.col("nb"), F.lit(1)))), 6).alias("ks"))


def bootstrap_mean(df: DataFrame, key: str, value: str, resamples: int = 200, seed: int = 42) -> DataFrame:
    """Percentile interval of a mean: every row takes part in each resample a number of times drawn by hash (Poisson 1), so resamples
    are one aggregation over rows times resamples with map-side sums, and the same on every run."""
    u = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col("b"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    steps, p, cdf = F.lit(0), math.exp(-1), 0.0
    for k in range(8):
        cdf += p
        steps = steps + F.when(u >= cdf, 1).otherwise(0)
        p /= k + 1
    rows = df.where(F.col(value).isNotNull()).select(key, value).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("w", steps)
    means = rows.groupBy("b").agg((F.sum(F.col("w") * F.col(value)) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    return means.agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.5)), 6).alias("mid"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"))


def cohen_h(p1: Column, p2: Column) -> Column:
    return 2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution function by bisection."""
    low, high = -12.0, 12.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if normal_cdf(mid) < p else (low, mid)
    return (low + high) / 2


def power_of_proportions(p1: float, p2: float, n: int, alpha: float = 0.05) -> float:
    """Power of a two-sided test of two shares with ``n`` in each group, by the arcsine effect size."""
    h = abs(2 * math.asin(math.sqrt(p1)) - 2 * math.asin(math.sqrt(p2)))
    return normal_cdf(h * math.sqrt(n / 2) - normal_quantile(1 - alpha / 2))


def sample_size(p1: float, p2: float, power: float = 0.8, alpha: float = 0.05) -> int:
    h = abs(2 * math.asin(math.sqrt(p1)) - 2 * math.asin(math.sqrt(p2)))
    return math.ceil(2 * ((normal_quantile(1 - alpha / 2) + normal_quantile(power)) / h) ** 2) if h else 0


def detectable_effect(n: int, power: float = 0.8, alpha: float = 0.05) -> float:
    return (normal_quantile(1 - alpha / 2) + normal_quantile(power)) / math.sqrt(n / 2)


def combined(columns: list[str]) -> dict[str, Column]:
    """Ensemble combiners of probability columns: soft, median, geometric, hard vote, most confident."""
    cols = [F.col(c).cast("double") for c in columns]
    votes = sum((c >= 0.5).cast("int") for c in cols)
    sure = F.greatest(*[F.struct(F.abs(c - 0.5).alias("d"), c.alias("p")) for c in cols])
    log_mean = M.mean_of(*[F.log(F.greatest(c, F.lit(1e-10))) for c in cols])
    return {"soft": M.mean_of(*cols), "median": M.median_of(*cols), "geometric": F.exp(log_mean), "hard": (votes * 2 > len(columns)).cast("double"), "confident": sure["p"]}
