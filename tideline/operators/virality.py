"""Features of a cluster's spread at the time of detection, and what became of it.

`features` reads rows up to the detection only; rows after it feed the target (`potential`) alone. `growth`, `gaps` and the other parts
describe whatever rows they are given."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import maths as M
from tideline.operators import aggregates as A
from tideline.operators import detect as D

#: Names of the features in their order.
FEATURES = (
    "cumulative_tweets cumulative_engagement windows_since_start mean_tweets_per_window mean_engagement_per_window growth_rate acceleration engagement_velocity engagement_jerk burstiness inter_arrival_mean inter_arrival_std inter_arrival_cv "
    "early_velocity_ratio final_window_ratio is_post_peak peak_position_ratio max_followers_seen avg_followers_seen total_unique_users engagement_per_follower amplification_factor z_score_at_detect max_z_score_seen z_score_count_at_detect z_score_engagement_at_detect kleinberg_state_at_detect "
    "geographic_entropy_predetect unique_countries_predetect hour_of_day is_weekend is_morning is_evening posting_hour_entropy max_retweets_per_tweet avg_likes_per_tweet rt_like_ratio engagement_skewness engagement_gini user_gini top_user_ratio account_age_avg_days"
).split()


def growth(series: DataFrame, entity: str = "cluster_id", at: str = "t", value: str = "n") -> DataFrame:
    """Over an entity's series: growth rate, mean absolute first and second differences, peak, share of the first quarter, final ratio."""
    w = Window.partitionBy(entity).orderBy(at)
    d = series.select(entity, at, F.col(value).cast("double").alias("v"))
    d = d.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(entity))).withColumn("d1", F.col("v") - F.lag("v").over(w))
    d = d.withColumn("d2", F.col("d1") - F.lag("d1").over(w))
    early = F.col("i") <= F.greatest(F.lit(1), F.floor(F.col("n") / 4))
    g = d.groupBy(entity).agg(
        F.count("*").alias("points"), F.min_by("v", "i").alias("first"), F.max_by("v", "i").alias("last"), F.max("v").alias("peak"), F.max_by("i", F.struct("v", -F.col("i"))).alias("peak_at"), F.avg(F.abs("d1")).alias("velocity"), F.avg(F.abs("d2")).alias("jerk"), F.sum(F.when(early, F.col("v")).otherwise(0.0)).alias("early"), F.sum("v").alias("total")
    )
    r = lambda c: F.round(c, 6)
    return g.select(
        entity, "points", r((F.col("last") - F.col("first")) / F.greatest(F.lit(1.0), F.col("first"))).alias("growth_rate"), r(F.coalesce("velocity", F.lit(0.0))).alias("velocity"), r(F.coalesce("jerk", F.lit(0.0))).alias("jerk"), "peak", r((F.col("peak_at") - 1) / F.greatest(F.col("points") - 1, F.lit(1))).alias("peak_position"),
        (F.col("peak_at") < F.col("points")).alias("is_post_peak"), r(F.col("early") / F.greatest(F.col("total"), F.lit(1.0))).alias("early_ratio"), r(F.col("last") / F.greatest(F.col("peak"), F.lit(1.0))).alias("final_ratio"),
    )


def features(posts: DataFrame, detected: DataFrame, states: bool = True) -> DataFrame:
    """The 42 features of each entity's spread before its detection; ``posts``: ``entity, post, user, at, retweets, likes, followers, country, joined``;
    ``detected``: ``entity, detect_at``. Posts after ``detect_at`` are dropped first, so no feature can see them.

    Per hour the series has posts, engagement, users and followers; its anomaly scores are `detections` of every row against the hours
    before. Everything is an aggregate with the entity as key; only ratios of aggregates are formed after the joins."""
    before = posts.join(detected, "entity").where(F.col("at") <= F.col("detect_at"))
    p = before.select("entity", "post", "user", F.col("at").cast("timestamp_ntz").alias("at"), "country", "joined", "followers", "detect_at", F.coalesce("retweets", F.lit(0)).alias("rt"), F.coalesce("likes", F.lit(0)).alias("lk"))
    p = p.withColumn("eng", F.col("rt") + F.col("lk"))
    one = lambda x: F.greatest(F.lit(1.0), x)
    zero = lambda c: F.coalesce(c, F.lit(0.0))

    windows = p.groupBy("entity", F.date_trunc("hour", "at").cast("timestamp_ntz").alias("t")).agg(F.count("*").alias("n"), F.sum("eng").cast("long").alias("e"), F.count_distinct("user").alias("users"), F.avg("followers").alias("mean_f"), F.max("followers").alias("max_f"))
    w = Window.partitionBy("entity").orderBy("t")
    s = windows.withColumn("i", F.row_number().over(w)).withColumn("k", F.count("*").over(Window.partitionBy("entity"))).withColumn("d1", F.col("e") - F.lag("e").over(w))
    s = s.withColumn("d2", F.col("d1") - F.lag("d1").over(w))
    g = s.groupBy("entity").agg(
        F.max("k").alias("k"), F.sum("n").cast("double").alias("tweets"), F.sum("e").cast("double").alias("e"), F.max_by("e", "i").alias("last"), F.min_by("e", "i").alias("first"), F.max_by("i", F.struct("e", -F.col("i"))).alias("peak"), F.max_by("d1", "i").alias("d_last"), F.min_by("d1", F.when(F.col("d1").isNotNull(), F.col("i"))).alias("d_first"),
        F.avg(F.abs("d1")).alias("v"), F.avg(F.abs("d2")).alias("j"), F.sum(F.when(F.col("i") <= F.greatest(F.lit(1), F.floor(F.col("k") / 4)), F.col("e")).otherwise(0)).alias("early"), F.max(zero(F.col("max_f"))).alias("max_f"), F.avg(zero(F.col("mean_f"))).alias("mean_f"), F.sum("users").cast("double").alias("users"),
    )
    two, three = F.col("k") >= 2, F.col("k") >= 3
    g = g.select(
        "entity", F.col("tweets").alias("cumulative_tweets"), F.col("e").alias("cumulative_engagement"), F.col("k").cast("double").alias("windows_since_start"), (F.col("tweets") / F.col("k")).alias("mean_tweets_per_window"), (F.col("e") / F.col("k")).alias("mean_engagement_per_window"),
        F.when(two, F.col("last") / one(F.col("first"))).otherwise(1.0).alias("growth_rate"), F.when(three, (F.col("d_last") - F.col("d_first")).cast("double")).otherwise(0.0).alias("acceleration"), F.when(three, F.col("v")).otherwise(0.0).alias("engagement_velocity"), F.when(three, F.col("j")).otherwise(0.0).alias("engagement_jerk"),
        F.when(two, F.col("early") / one(F.col("e"))).otherwise(1.0).alias("early_velocity_ratio"), F.when(two, F.col("last") / one(F.col("e"))).otherwise(1.0).alias("final_window_ratio"), F.when(two & (F.col("peak") < F.col("k")), 1.0).otherwise(0.0).alias("is_post_peak"), F.when(two, (F.col("peak") - 1) / one(F.col("k") - 1)).otherwise(1.0).alias("peak_position_ratio"),
        F.col("max_f").cast("double").alias("max_followers_seen"), F.col("mean_f").alias("avg_followers_seen"), F.col("users").alias("total_unique_users"), (F.col("e") / one(F.col("mean_f") * F.col("users"))).alias("engagement_per_follower"),
    )

    scores = D.detections(windows.select("entity", "t", "n", "e"), bayesian=False)
    z = scores.groupBy("entity").agg(zero(F.max_by("z", "t")).alias("z_score_at_detect"), F.max(zero(F.col("z"))).alias("max_z_score_seen"), zero(F.max_by("z_count", "t")).alias("z_score_count_at_detect"), zero(F.max_by("z_engagement", "t")).alias("z_score_engagement_at_detect"), F.max_by("state", "t").cast("double").alias("kleinberg_state_at_detect"))

    off = F.col("eng") - F.col("m1")
    m = p.join(p.groupBy("entity").agg(F.avg("eng").alias("m1")), "entity").groupBy("entity").agg(F.avg(off * off).alias("m2"), F.avg(off * off * off).alias("m3"), F.stddev_pop("eng").alias("sd"), F.sum("rt").cast("double").alias("rt"), F.sum("lk").cast("double").alias("lk"), F.max("rt").cast("double").alias("max_rt"), F.avg("lk").alias("mean_lk"), F.avg(F.floor(F.timestamp_diff("SECOND", F.col("joined").cast("timestamp_ntz"), F.col("at")) / 86400)).alias("age"), F.max("detect_at").alias("d"))
    hour = F.hour("d")
    m = m.select(
        "entity", F.when(F.col("sd") > 0, F.col("m3") / F.pow("m2", F.lit(1.5))).otherwise(0.0).alias("engagement_skewness"), F.col("max_rt").alias("max_retweets_per_tweet"), F.col("mean_lk").alias("avg_likes_per_tweet"), (F.col("rt") / one(F.col("lk"))).alias("rt_like_ratio"), F.col("rt").alias("_rt"), zero(F.col("age")).alias("account_age_avg_days"),
        hour.cast("double").alias("hour_of_day"), F.dayofweek("d").isin(1, 7).cast("double").alias("is_weekend"), ((hour >= 6) & (hour < 12)).cast("double").alias("is_morning"), (hour >= 18).cast("double").alias("is_evening"),
    )
    gap = gaps(p.withColumn("s", F.date_trunc("second", "at").cast("timestamp_ntz")), "entity", "s", "post")
    enough = F.col("gaps") >= 2
    gap = gap.select("entity", F.when(enough, F.col("burstiness")).otherwise(0.0).alias("burstiness"), F.when(enough, F.col("mean_gap")).otherwise(0.0).alias("inter_arrival_mean"), F.when(enough, F.col("std_gap")).otherwise(0.0).alias("inter_arrival_std"), F.when(enough, F.col("cv")).otherwise(0.0).alias("inter_arrival_cv"))

    def nats(rows: DataFrame, category: str, name: str) -> DataFrame:
        c = rows.where(F.col(category).isNotNull()).groupBy("entity", category).agg(F.count("*").alias("c"))
        share = F.col("c") / F.sum("c").over(Window.partitionBy("entity"))
        return c.select("entity", (-share * F.log(share + 1e-10)).alias("h")).groupBy("entity").agg(F.sum("h").alias(name), F.count("*").cast("double").alias("kinds"))

    geo = nats(p, "country", "geographic_entropy_predetect").withColumnRenamed("kinds", "unique_countries_predetect")
    hours = nats(p.withColumn("h", F.hour("at")), "h", "posting_hour_entropy").drop("kinds")
    users = p.groupBy("entity", "user").agg(F.count("*").alias("c"))
    top = users.groupBy("entity").agg((F.max("c") / F.sum("c")).alias("top_user_ratio"))
    ginis = [A.gini(x, "entity", c).select("entity", F.col("gini").alias(name)) for x, c, name in ((p, "eng", "engagement_gini"), (users, "c", "user_gini"))]
    out = g
    for part in (z, m, gap, geo, hours, top, *ginis):
        out = out.join(part, "entity", "left")
    out = out.withColumn("amplification_factor", F.col("_rt") / one(F.col("total_unique_users")))
    return out.select("entity", *[F.round(zero(F.col(c)), 6).alias(c) for c in FEATURES if states or c != "kleinberg_state_at_detect"])


def gaps(posts: DataFrame, entity: str, at: str, order: str) -> DataFrame:
    """Times between an entity's posts in seconds: mean, deviation, coefficient of variation, burstiness."""
    w = Window.partitionBy(entity).orderBy(at, order)
    d = posts.select(entity, F.timestamp_diff("SECOND", F.lag(at).over(w), F.col(at)).alias("gap")).where("gap is not null")
    g = d.groupBy(entity).agg(F.count("*").alias("gaps"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("std"))
    return g.select(entity, "gaps", F.round("mean", 4).alias("mean_gap"), F.round("std", 4).alias("std_gap"), F.round(M.ratio(F.col("std"), F.col("mean")), 6).alias("cv"), F.round(M.burstiness(F.col("mean"), F.col("std"), F.col("gaps")), 6).alias("burstiness"))


def smoothed_entropy(df: DataFrame, entity: str, category: str, bins: int | None = None, eps: float = 1e-10) -> DataFrame:
    """Entropy in nats with every probability raised by ``eps``; with ``bins``, empty bins add -eps ln eps each."""
    c = df.where(F.col(category).isNotNull()).groupBy(entity, category).agg(F.count("*").alias("c"))
    total = c.groupBy(entity).agg(F.sum("c").alias("n"), F.count("*").alias("k"))
    p = F.col("c") / F.col("n") + eps
    h = c.join(total, entity).groupBy(entity).agg(F.sum(-p * F.log(p)).alias("h"), F.max("k").alias("k"))
    import math

    empty = F.lit(0.0) if bins is None else (bins - F.col("k")) * (-eps * math.log(eps))
    return h.select(entity, F.round(F.col("h") + empty, 6).alias("entropy"))


def concentration(posts: DataFrame, entity: str, user: str) -> DataFrame:
    """Posts per user, share of the most active user, share of users with one post."""
    u = posts.where(F.col(user).isNotNull()).groupBy(entity, user).agg(F.count("*").alias("c"))
    return u.groupBy(entity).agg(F.round(F.sum("c") / F.count("*"), 6).alias("per_user"), F.round(F.max("c") / F.sum("c"), 6).alias("top_share"), F.round(F.count_if(F.col("c") == 1) / F.count("*"), 6).alias("single_share"))


def potential(posts: DataFrame, entity: str, at: str, engagement: F.Column | None, detect_hours: int = 6) -> DataFrame:
    """Share of the final engagement that came after detection (first post plus ``detect_hours``); 1 where there was none."""
    first = posts.groupBy(entity).agg(F.min(at).alias("_f"))
    d = posts.join(first, entity)
    until = F.timestamp_add("SECOND", F.lit(detect_hours * 3600), F.col("_f"))
    e = engagement
    g = d.groupBy(entity).agg(F.sum(e).alias("final"), F.sum(F.when(F.col(at) <= until, e).otherwise(0)).alias("detected"))
    return g.select(entity, "final", "detected", F.round(F.when(F.col("final") == 0, 1.0).otherwise((F.col("final") - F.col("detected")) / F.nullif(F.col("final"), F.lit(0))), 6).alias("psr"))
