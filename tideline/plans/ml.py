"""Model surface: topics, text vectors, event classifier, claim normaliser."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import text as X
from tideline.operators import models as L
from tideline.plans._register import Plans
from tideline.plans.virality import ud06_popular_events
from tideline.sources.tables import table

PLANS = Plans()


@PLANS()
def sm17_topics(s, d):
    """SM17, UD14: scaled, reduced and clustered vectors."""
    return L.topics(table(s, d, "embeddings"), "embedding", 10).select("vec_id", "topic")


@PLANS()
def ud07_text_vectors(s, d):
    t = table(s, d, "normalizations").select("sentence_id", "text").distinct()
    return L.embedded(t, "text").select("sentence_id", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm2"))


@PLANS()
def ud06_event_classifier(s, d):
    """UD06: depth-4 tree on event features against the median split; trained on users of four folds, scored on the fifth."""
    e = ud06_popular_events(s, d).withColumn("popular", F.col("popular").cast("int"))
    fold = F.pmod(F.xxhash64("user_id"), F.lit(5)) == 0
    return L.scored(e.where(~fold), e.where(fold), ["peek", "session"], "popular", "tree").select("user_id", "session", "popular", "probability")


@PLANS()
def ud09_checkworthiness(s, d):
    """UD09, UD13: boosted trees on linguistic features; trained on train, scored on the other splits."""
    n = table(s, d, "normalizations").where("label is not null").select("sentence_id", "text", "label", "split").distinct()
    f = X.linguistic_features(F.col("text"))
    feats = n.select("sentence_id", "split", (F.lower("label") == "yes").cast("int").alias("y"), *[v.cast("double").alias(k) for k, v in f.items()])
    return L.scored(feats.where("split = 'train'"), feats.where("split != 'train'"), list(f), "y", "gbt").select("sentence_id", "split", F.col("y").alias("truth"), "probability")


@PLANS("WITH p AS (SELECT cluster_id, tweet_id, min(text) AS text, max(retweet_count_at_collection + likes_at_collection) AS e FROM tweets WHERE cluster_id >= 0 GROUP BY 1, 2) SELECT cluster_id, text FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY e DESC, tweet_id) AS k FROM p) WHERE k = 1")
def ud08_claim_baseline(s, d):
    """UD08: a cluster's claim without a hosted model is its post with most engagement."""
    p = table(s, d, "tweets").where("cluster_id >= 0").groupBy("cluster_id", "tweet_id").agg(F.min("text").alias("text"), F.max(F.col("retweet_count_at_collection") + F.col("likes_at_collection")).alias("e"))
    return p.groupBy("cluster_id").agg(F.min_by("text", F.struct((-F.col("e")).alias("e"), "tweet_id")).alias("text"))
