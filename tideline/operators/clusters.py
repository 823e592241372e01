"""Relations around clusters: statistics per window, users, places, votes, the dense series; online clustering and claim registry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.ranking import best_by_key
from tideline.operators.staging import delete, stage


def posts_once(tweets: DataFrame) -> DataFrame:
    """One row a tweet: the first collected; gate-passing rows of real clusters only."""
    t = tweets.where("passes_claim_gate and cluster_id >= 0 and tweet_id is not null")
    return best_by_key(t, ["tweet_id"], [F.col(c).asc_nulls_last() for c in ("collected_at", "likes_at_collection", "retweet_count_at_collection")])


def window_stats(posts: DataFrame, unit: str = "day") -> DataFrame:
    """Per cluster and window: activity and authority."""
    t = F.date_trunc(unit, "created_at").cast("timestamp_ntz")
    engagement = F.col("retweet_count_at_collection") + F.col("likes_at_collection")
    return posts.groupBy("cluster_id", t.alias("t")).agg(
        F.count("*").alias("n"), F.sum(engagement).alias("engagement"), F.count_distinct("user_id").alias("users"), F.round(F.avg("user_followers_count"), 6).alias("mean_followers"), F.max("user_followers_count").alias("max_followers"), F.count_if("user_verified").alias("verified")
    )


def totals(posts: DataFrame) -> DataFrame:
    """Cumulative state of a cluster: first and last window, tweets, users, engagement."""
    hour = F.date_trunc("hour", "created_at").cast("timestamp_ntz")
    return posts.groupBy("cluster_id").agg(F.min(hour).alias("first_seen"), F.max(hour).alias("last_seen"), F.count("*").alias("tweets"), F.count_distinct("user_id").alias("users"), F.sum(F.col("retweet_count_at_collection") + F.col("likes_at_collection")).alias("engagement"))


def geography(posts: DataFrame, home: str = "United States") -> DataFrame:
    """Distinct countries and states, share of the home country, whether others appear, the most frequent country (ties: first by name); null without places."""
    c = posts.where("country is not null").groupBy("cluster_id", "country").agg(F.count("*").alias("c"))
    per = c.groupBy("cluster_id").agg(F.count("*").alias("countries"), F.sum("c").alias("placed"), F.sum(F.when(F.col("country") == home, F.col("c")).otherwise(0)).alias("_home"), F.max_by("country", F.struct("c", F.expr("-ascii(country)"))).alias("_m"), F.min(F.struct((-F.col("c")).alias("c"), "country")).alias("_d"))
    states = posts.where("state is not null").groupBy("cluster_id").agg(F.count_distinct("state").alias("states"))
    return per.join(states, "cluster_id", "left").select("cluster_id", "countries", "states", "placed", F.round(F.col("_home") / F.col("placed"), 6).alias("home_ratio"), ((F.col("countries") > 1) | (F.col("_home") == 0)).alias("international"), F.col("_d.country").alias("dominant"))


def dense_series(stats: DataFrame, unit: str = "day") -> DataFrame:
    """Every cluster at every window from its first to the last of all, zero where nothing happened.

    The grid is generated from each cluster's own span, not by a product of clusters and windows."""
    last = stats.agg(F.max("t").alias("_last"))
    span = stats.groupBy("cluster_id").agg(F.min("t").alias("_first")).join(F.broadcast(last))
    grid = span.select("cluster_id", F.explode(F.sequence("_first", "_last", F.expr(f"INTERVAL '1' {unit.upper()}"))).alias("t"))
    return grid.join(stats, ["cluster_id", "t"], "left").na.fill(0, ["n", "engagement", "users", "verified"])


def first_users(posts: DataFrame) -> DataFrame:
    """One row a user as first seen."""
    one = best_by_key(posts.where("user_id is not null"), ["user_id"], [F.col("created_at"), F.col("tweet_id")])
    return one.select("user_id", F.col("user_screen_name").alias("username"), F.col("user_followers_count").alias("followers_at_collection"), F.col("user_verified").alias("verified"))


def leader_cluster(vectors: np.ndarray, threshold: float, centroids: list[np.ndarray] | None = None, counts: list[int] | None = None, cap: int | None = None, update: bool = True) -> tuple[list[int], list[float]]:
    """Sequential clustering: a vector joins the nearest centroid at cosine ``threshold`` or more (running mean, renormalised), else
    starts a new one. At the cap it joins the nearest without changing it and reports similarity 1. State is changed in place."""
    cs, ns = (centroids if centroids is not None else []), (counts if counts is not None else [])
    ids, sims = [], []
    m = np.array(cs, np.float64) if cs else np.zeros((0, vectors.shape[1] if len(vectors) else 0))
    for v in vectors.astype(np.float64):
        v = v / max(float(np.linalg.norm(v)), 1e-10)
        best, sim = -1, -2.0
        if len(m):
            s = m @ v
            best = int(s.argmax())
            sim = float(s[best])
        if best >= 0 and sim >= threshold:
            ns[best] += 1
            if update:
                c = m[best] + (v - m[best]) / ns[best]
                m[best] = c / max(float(np.linalg.norm(c)), 1e-10)
            ids.append(best)
            sims.append(sim)
        elif cap is not None and len(m) >= cap:
            ids.append(best)
            sims.append(1.0)
        else:
            m = np.vstack([m, v]) if len(m) else v[None, :]
            ns.append(1)
            ids.append(len(m) - 1)
            sims.append(1.0)
    cs[:] = list(m)
    return ids, sims


def online_clusters(df: DataFrame, key: str, vector: str, threshold: float = 0.75, shard: str | None = None) -> DataFrame:
    """Exact sequential clustering in order of ``key`` within each shard.

    The result of a sequential algorithm depends on every earlier row, so one shard is one ordered task by definition: choose
    a shard column (a day, a language, a coarse cell of `mini_batch_leaders`) to bound it; without one the whole table is one."""
    rows = df.select(F.col(key).alias("k"), F.col(vector).alias("v"), (F.lit(0) if shard is None else F.col(shard)).alias("s"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        ids, sims = leader_cluster(np.stack(pdf["v"].to_numpy()), threshold)
        return pd.DataFrame({"k": pdf["k"].to_numpy(), "s": pdf["s"].to_numpy(), "cluster": ids, "similarity": np.round(sims, 6)})

    kinds = dict(rows.dtypes)
    return rows.groupBy("s").applyInPandas(run, f"k {kinds['k']}, s {kinds['s']}, cluster int, similarity double").withColumnsRenamed({"k": key, "s": "shard"})


def mini_batch_leaders(df: DataFrame, key: str, vector: str, threshold: float = 0.75, most: int = 5000) -> DataFrame:
    """Clustering by leaders that scales: every row joins its nearest leader, at cosine ``threshold`` or more. Leaders are rows.

    In rounds, each task proposes leaders among its rows that no leader is near to, at most ``most`` of them become leaders and all
    rows are compared with these, until every row has one; ``most`` bounds memory, not the number of clusters. Differs from the
    sequential result, as leaders don't move. Zero vectors are one cluster."""
    kind = dict(df.dtypes)[key]
    state = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), F.lit(-1).alias("cluster"), F.lit(-2.0).alias("similarity"))
    near = threshold - 1e-9

    def unit(vectors: pd.Series) -> np.ndarray:
        """Rows of length 1; one more coordinate stands for vectors without a direction."""
        x = np.stack(vectors.to_numpy()).astype(np.float64)
        n = np.linalg.norm(x, axis=1)
        none = ~(np.isfinite(n) & (n > 1e-10))
        x[none], n[none] = 0, 1
        return np.hstack([x / n[:, None], none[:, None]])

    def leaders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cs: list[np.ndarray] = []
        ns: list[int] = []
        for pdf in batches:
            if len(pdf):
                leader_cluster(unit(pdf["v"]), threshold, cs, ns, cap=most, update=False)
        if cs:
            yield pd.DataFrame({"v": [c.tolist() for c in cs], "n": ns})

    found_before, first = None, 0
    while True:
        found = state.where(F.col("similarity") < near).mapInPandas(leaders, "v array<double>, n long").orderBy(F.desc("n"), "v").limit(most).toPandas()
        if not len(found):
            break
        cs: list[np.ndarray] = []
        leader_cluster(np.stack(found["v"].to_numpy()), threshold, cs, [], update=False)

        def assign(batches: Iterator[pd.DataFrame], matrix: np.ndarray = np.array(cs), first: int = first) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    s = unit(pdf["v"]) @ matrix.T
                    better = s.max(1) > pdf["similarity"].to_numpy()
                    yield pdf.assign(cluster=np.where(better, first + s.argmax(1), pdf["cluster"]), similarity=np.where(better, s.max(1), pdf["similarity"]))

        state = stage(state.mapInPandas(assign, f"k {kind}, v array<double>, cluster int, similarity double"), "leaders")
        first += len(cs)
        if found_before:
            delete(df.sparkSession, found_before)
        found_before = state.inputFiles()[0].rsplit("/", 1)[0]
    return state.select(F.col("k").alias(key), "cluster", F.round("similarity", 6).alias("similarity"))


def claim_registry(clusters: DataFrame, key: str, order: str, vector: str, threshold: float = 0.85) -> DataFrame:
    """Claims of clusters: a cluster seen before keeps its claim, else it merges into the nearest existing claim at the threshold or
    more, else it is a new one; claim vectors don't move. Clusters come once each, in order of (``order``, ``key``)."""
    rows = clusters.groupBy(key).agg(F.min(F.struct(F.col(order).alias("o"), F.col(vector).alias("v"))).alias("x")).select(F.col(key).alias("k"), "x.o", "x.v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["o", "k"])
        ids, _ = leader_cluster(np.stack(pdf["v"].to_numpy()), threshold, update=False)
        return pd.DataFrame({"k": pdf["k"].to_numpy(), "claim": ids})

    kind = dict(rows.dtypes)["k"]
    return rows.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(run, f"k {kind}, claim int").withColumnRenamed("k", key)
