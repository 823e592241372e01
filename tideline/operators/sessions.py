"""Sessions by gaps and what happens inside and after them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.time import seconds_between


def sessionize(df: DataFrame, key: str, at: str, gap_hours: float = 6.0, order: list[str] | None = None, name: str = "session") -> DataFrame:
    """Number of the session of each row; a new one begins when the gap is longer than ``gap_hours`` (equal is not)."""
    w = Window.partitionBy(key).orderBy(at, *(order or []))
    gap = seconds_between(F.lag(at).over(w), F.col(at))
    # whole seconds would lose a part of one: compare with the boundary itself
    late = F.col(at) > F.timestamp_add("SECOND", F.lit(int(gap_hours * 3600)), F.lag(at).over(w))
    new = F.when(gap.isNull(), 0).otherwise(late.cast("int"))
    return df.withColumn("_n", new).withColumn(name, F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_n")


def events(df: DataFrame, key: str, at: str, score: str, gap_hours: float = 6.0) -> DataFrame:
    """One row a session: start, end, highest and first score, rows."""
    s = sessionize(df, key, at, gap_hours, [score])
    return s.groupBy(key, "session").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.max(score).alias("max_score"), F.min_by(score, F.struct(at, score)).alias("first_score"), F.count("*").alias("n"))


def facts_of_events(events_: DataFrame, facts: DataFrame, key: str, at: str, peek_hours: int = 6, horizon_hours: int = 168, bucket_hours: int = 24) -> DataFrame:
    """Facts from an event's start to ``horizon_hours`` after its first ``peek_hours``, with ``_early`` for those within the latter; one range join.

    Both sides are cut into time buckets: an event meets only facts of the buckets its span touches, so a key with years of facts
    is not joined in full, and the join keys (key, bucket) spread a hot key over tasks."""
    e = events_.select(key, "session", "start")
    span = (peek_hours + horizon_hours) * 3600
    size = bucket_hours * 3600
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    place = lambda c: F.floor(seconds_between(epoch, c) / size)
    first = place(F.col("start"))
    e = e.withColumn("_b", F.explode(F.sequence(first, place(F.timestamp_add("SECOND", F.lit(span), F.col("start"))))))
    f = facts.withColumnRenamed(at, "_t").withColumn("_b", place(F.col("_t")))
    peek_end = F.timestamp_add("SECOND", F.lit(peek_hours * 3600), F.col("start"))
    end = F.timestamp_add("SECOND", F.lit(span), F.col("start"))
    j = e.join(f, [key, "_b"]).where((F.col("_t") >= F.col("start")) & (F.col("_t") < end))
    return j.withColumn("_early", F.col("_t") < peek_end).drop("_b")


def peek_and_horizon(events_: DataFrame, facts: DataFrame, key: str, at: str, value: str, peek_hours: int = 6, horizon_hours: int = 168, bucket_hours: int = 24) -> DataFrame:
    """Facts within the first hours of an event and within the hours after those: numbers and sums of ``value``."""
    j = facts_of_events(events_, facts.select(key, at, F.col(value).alias("_v")), key, at, peek_hours, horizon_hours, bucket_hours)
    early = F.col("_early")
    agg = j.groupBy(key, "session").agg(F.count_if(early).alias("peek_n"), F.coalesce(F.sum(F.when(early, F.col("_v"))), F.lit(0)).alias("peek_v"), F.count_if(~early).alias("later_n"), F.coalesce(F.sum(F.when(~early, F.col("_v"))), F.lit(0)).alias("later_v"))
    return events_.select(key, "session", "start").join(agg, [key, "session"], "left").na.fill(0, ["peek_n", "peek_v", "later_n", "later_v"])


def event_features(events_: DataFrame, facts: DataFrame, key: str, at: str, least: int = 1, peek_hours: int = 6, horizon_days: int = 7) -> DataFrame:
    """The fifteen features of an event's first hours and the engagement of the days after them (the target, which no feature sees).

    events_: `events`; facts: ``retweets, replies, likes`` (numbers) and ``url, photo, video, quote, retweet`` (booleans), ``hashtags`` (number)
    beside key and time. Events with fewer than ``least`` facts in the first hours are left out."""
    counts = [F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("retweets", "replies", "likes", "hashtags")]
    flags = [F.coalesce(F.col(c), F.lit(False)).cast("double").alias(c) for c in ("url", "photo", "video", "quote", "retweet")]
    f = facts.select(key, at, *counts, *flags).withColumn("e", F.col("retweets") + F.col("replies") + F.col("likes"))
    j = facts_of_events(events_, f, key, at, peek_hours, 24 * horizon_days)
    early, half = F.col("_early"), F.col("_t") < F.timestamp_add("SECOND", F.lit(peek_hours * 1800), F.col("start"))
    peek = lambda c, when=early: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0.0))
    g = j.groupBy(key, "session").agg(
        F.count_if(early).alias("n"), peek("e").alias("e"), peek("e", early & half).alias("e1"), F.count_if(early & half).alias("n1"), peek("e", early & ~half).alias("e2"), F.count_if(early & ~half).alias("n2"), *[peek(c).alias(c) for c in ("retweets", "replies", "hashtags", "url", "photo", "video", "quote", "retweet")], peek("e", ~early).alias("horizon_engagement")
    )
    d = events_.select(key, "session", "start", "first_score", "max_score").join(g.where(F.col("n") >= least), [key, "session"])
    one = lambda c: F.greatest(F.col(c), F.lit(1))
    share = lambda c: F.round(F.col(c) / F.col("n"), 6)
    return d.select(
        key, "session", F.col("first_score").cast("double").alias("z_score_at_detection"), F.col("max_score").cast("double").alias("z_max_peek"), F.round(F.col("e2") / one("n2") - F.col("e1") / one("n1"), 6).alias("momentum"), F.round(F.col("retweets") / one("e"), 6).alias("rt_ratio"), F.round(F.col("replies") / one("e"), 6).alias("reply_ratio"), share("e").alias("engagement_efficiency"), F.col("n").alias("tweet_volume"),
        share("url").alias("url_density"), F.round((F.col("photo") + F.col("video")) / F.col("n"), 6).alias("media_density"), share("video").alias("video_density"), share("hashtags").alias("hashtag_avg"), share("quote").alias("quote_ratio"), share("retweet").alias("retweet_ratio"), F.hour("start").alias("hour_of_day"), F.dayofweek("start").isin(1, 7).cast("int").alias("is_weekend"), "horizon_engagement",
    )
