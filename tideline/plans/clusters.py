"""The relations of the claim-detection pipeline: clusters, users, claims, statistics and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import aggregates as A
from tideline.operators import clusters as C
from tideline.operators.ranking import top_per_group
from tideline.plans._register import Plans
from tideline.sources.tables import table

PLANS = Plans()
_POSTS = "p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY collected_at, likes_at_collection, retweet_count_at_collection) AS k FROM tweets WHERE passes_claim_gate AND cluster_id >= 0 AND tweet_id IS NOT NULL) WHERE k = 1)"


def _posts(s, d):
    return C.posts_once(table(s, d, "tweets"))


@PLANS("""WITH z AS (SELECT cluster_id, count(*) AS n FROM tweets WHERE cluster_id >= 0 GROUP BY 1) SELECT count(*) AS groups, round(avg(n), 6) AS mean, median(n) AS median, min(n) AS low, max(n) AS high, count(*) FILTER (n <= 1) AS upto_1, count(*) FILTER (n > 1 AND n <= 2) AS upto_2, count(*) FILTER (n > 2 AND n <= 5) AS upto_5,
count(*) FILTER (n > 5 AND n <= 10) AS upto_10, count(*) FILTER (n > 10 AND n <= 50) AS upto_50, count(*) FILTER (n > 50) AS over FROM z""")
def ag13_cluster_sizes(s, d):
    return A.size_bands(table(s, d, "tweets").where("cluster_id >= 0"), "cluster_id")


@PLANS("SELECT cluster_id, count(*) AS n, round(avg(CASE WHEN isnan(cluster_similarity) THEN NULL ELSE cluster_similarity END), 6) AS similarity FROM tweets WHERE cluster_id >= 0 GROUP BY 1 ORDER BY n DESC, cluster_id LIMIT 10")
def ag14_top_clusters(s, d):
    sim = F.when(~F.isnan("cluster_similarity"), F.col("cluster_similarity"))
    return table(s, d, "tweets").where("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("n"), F.round(F.avg(sim), 6).alias("similarity")).orderBy(F.desc("n"), "cluster_id").limit(10)


@PLANS(f"WITH {_POSTS}, big AS (SELECT cluster_id FROM p GROUP BY 1 ORDER BY count(*) DESC, cluster_id LIMIT 1) SELECT cluster_id, count(*) AS n, round(avg(likes_at_collection), 6) AS likes, CAST(sum(retweet_count_at_collection) AS BIGINT) AS retweets, min(tweet_id) AS sample FROM p WHERE cluster_id IN (SELECT cluster_id FROM big) GROUP BY 1")
def ag15_one_cluster(s, d):
    p = _posts(s, d)
    big = p.groupBy("cluster_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster_id").limit(1).select("cluster_id")
    return p.join(F.broadcast(big), "cluster_id").groupBy("cluster_id").agg(F.count("*").alias("n"), F.round(F.avg("likes_at_collection"), 6).alias("likes"), F.sum("retweet_count_at_collection").alias("retweets"), F.min("tweet_id").alias("sample"))


_WINDOW = "w AS (SELECT cluster_id, date_trunc('day', created_at)::TIMESTAMP AS t, count(*) AS n, CAST(sum(retweet_count_at_collection + likes_at_collection) AS BIGINT) AS engagement, count(DISTINCT user_id) AS users, round(avg(user_followers_count), 6) AS mean_followers, max(user_followers_count) AS max_followers, count(*) FILTER (user_verified) AS verified FROM p GROUP BY 1, 2)"


@PLANS(f"WITH {_POSTS}, {_WINDOW} SELECT * FROM w")
def ag16_window_stats(s, d):
    """AG16, AG17."""
    return C.window_stats(_posts(s, d))


@PLANS(f"WITH {_POSTS} SELECT cluster_id, date_trunc('hour', min(created_at))::TIMESTAMP AS first_seen, date_trunc('hour', max(created_at))::TIMESTAMP AS last_seen, count(*) AS tweets, count(DISTINCT user_id) AS users, CAST(sum(retweet_count_at_collection + likes_at_collection) AS BIGINT) AS engagement FROM p GROUP BY 1")
def ag18_cluster_totals(s, d):
    """AG18, SM14."""
    return C.totals(_posts(s, d))


@PLANS("WITH c AS (SELECT cluster_id, country, count(*) AS c FROM tweets WHERE cluster_id >= 0 AND country IS NOT NULL GROUP BY 1, 2), n AS (SELECT cluster_id, sum(c) AS n, count(*) AS categories FROM c GROUP BY 1) SELECT cluster_id, round(greatest(-sum(c / n * log2(c / n)), 0), 6) AS entropy, max(categories) AS categories FROM c JOIN n USING (cluster_id) GROUP BY cluster_id")
def ag19_entropy(s, d):
    return A.entropy(table(s, d, "tweets").where("cluster_id >= 0"), "cluster_id", "country")


@PLANS(f"""WITH {_POSTS}, c AS (SELECT cluster_id, country, count(*) AS c FROM p WHERE country IS NOT NULL GROUP BY 1, 2), st AS (SELECT cluster_id, count(DISTINCT state) AS states FROM p WHERE state IS NOT NULL GROUP BY 1)
SELECT c.cluster_id, count(*) AS countries, max(states) AS states, CAST(sum(c) AS BIGINT) AS placed, round(coalesce(sum(c) FILTER (country = 'United States'), 0) / sum(c), 6) AS home_ratio, count(*) > 1 OR coalesce(sum(c) FILTER (country = 'United States'), 0) = 0 AS international, first(country ORDER BY c DESC, country) AS dominant FROM c LEFT JOIN st USING (cluster_id) GROUP BY c.cluster_id""")
def ag20_geography(s, d):
    return C.geography(_posts(s, d))


@PLANS("WITH u AS (SELECT event_type, user_id, avg(floor(value)) AS m, sum(floor(value)) AS sv, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, round(sum(sv) / sum(n), 6) AS naive_mean, round(avg(m), 6) AS vote_mean, round(stddev_pop(m), 6) AS vote_std, round(sum(n) / count(*), 6) AS per_user FROM u GROUP BY 1")
def ag21_one_vote(s, d):
    return A.one_vote(table(s, d, "events").withColumn("v", F.floor("value")), "event_type", "user_id", "v")


@PLANS("WITH r AS (SELECT cluster_id, likes_at_collection::DOUBLE AS x, row_number() OVER (PARTITION BY cluster_id ORDER BY likes_at_collection) AS i, count(*) OVER (PARTITION BY cluster_id) AS n FROM tweets WHERE cluster_id >= 0) SELECT cluster_id, round(CASE WHEN sum(x) = 0 THEN 0.0 ELSE (2 * sum(i * x) - (max(n) + 1) * sum(x)) / (max(n) * sum(x)) END, 6) AS gini FROM r GROUP BY cluster_id")
def ag22_gini(s, d):
    return A.gini(table(s, d, "tweets").where("cluster_id >= 0"), "cluster_id", "likes_at_collection")


@PLANS("SELECT source, round(stddev_pop(likes_at_collection), 5) AS pop, round(stddev_samp(likes_at_collection), 5) AS samp FROM tweets GROUP BY source")
def ag23_deviations(s, d):
    return table(s, d, "tweets").groupBy("source").agg(F.round(F.stddev_pop("likes_at_collection"), 5).alias("pop"), F.round(F.stddev_samp("likes_at_collection"), 5).alias("samp"))


@PLANS(f"WITH {_POSTS} SELECT cluster_id, strftime(created_at, '%Y-%m-%d') AS day, string_agg(tweet_id, ' ' ORDER BY created_at, tweet_id) AS ids FROM p GROUP BY 1, 2")
def ag24_concatenate(s, d):
    """AG24: ids of a cluster's day in order; days keep the lists of a hot cluster short."""
    one = _posts(s, d).groupBy("cluster_id", F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.array_sort(F.collect_list(F.struct("created_at", "tweet_id"))).alias("x"))
    return one.select("cluster_id", "day", F.array_join(F.transform("x", lambda x: x["tweet_id"]), " ").alias("ids"))


@PLANS(f"WITH {_POSTS} SELECT count(*) AS tweets, count(DISTINCT cluster_id) AS clusters, round(count(*) / count(DISTINCT cluster_id), 6) AS per_cluster, round(1.0 - count(DISTINCT cluster_id) / count(*), 6) AS dedup_rate FROM p")
def ag32_registry_stats(s, d):
    """AG32, AG33: rollup over windows."""
    c = F.count_distinct("cluster_id")
    return _posts(s, d).agg(F.count("*").alias("tweets"), c.alias("clusters"), F.round(F.count("*") / c, 6).alias("per_cluster"), F.round(1.0 - c / F.count("*"), 6).alias("dedup_rate"))


@PLANS(f"WITH {_POSTS}, {_WINDOW}, l AS (SELECT max(t) AS b FROM w), f AS (SELECT cluster_id, min(t) AS a FROM w GROUP BY 1), g AS (SELECT cluster_id, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS t FROM f, l) SELECT g.cluster_id, g.t, coalesce(n, 0) AS n, coalesce(engagement, 0) AS engagement, coalesce(users, 0) AS users, mean_followers, max_followers, coalesce(verified, 0) AS verified FROM g LEFT JOIN w ON w.cluster_id = g.cluster_id AND w.t = g.t")
def jn16_dense_series(s, d):
    """JN16, SM15."""
    return C.dense_series(C.window_stats(_posts(s, d)))


@PLANS(f"WITH {_POSTS} SELECT user_id, user_screen_name AS username, user_followers_count AS followers_at_collection, user_verified AS verified FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, tweet_id) AS r FROM p WHERE user_id IS NOT NULL) WHERE r = 1")
def sm16_first_users(s, d):
    return C.first_users(_posts(s, d))


@PLANS(f"WITH {_POSTS} SELECT cluster_id, tweet_id, r FROM (SELECT cluster_id, tweet_id, row_number() OVER (PARTITION BY cluster_id ORDER BY likes_at_collection + retweet_count_at_collection DESC, tweet_id) AS r FROM p) WHERE r <= 3")
def sr03_representatives(s, d):
    p = _posts(s, d).select("cluster_id", "tweet_id", (F.col("likes_at_collection") + F.col("retweet_count_at_collection")).alias("e"))
    return top_per_group(p, ["cluster_id"], [F.desc("e"), "tweet_id"], 3, "r").select("cluster_id", "tweet_id", F.col("r").cast("bigint").alias("r"))


@PLANS()
def sm08_online_clusters(s, d):
    """Sequential clustering of all vectors within their labels; against a loop in the tests."""
    return C.online_clusters(table(s, d, "embeddings"), "vec_id", "embedding", 0.75, shard="label")


@PLANS()
def sm08_mini_batch(s, d):
    return C.mini_batch_leaders(table(s, d, "embeddings"), "vec_id", "embedding", 0.75)


@PLANS()
def sm13_claim_registry(s, d):
    return C.claim_registry(table(s, d, "embeddings"), "vec_id", "label", "embedding", 0.85)


@PLANS(f"WITH {_POSTS} SELECT tweet_id, user_id, cluster_id, created_at, retweet_count_at_collection, likes_at_collection, passes_claim_gate, strftime(created_at, '%Y-%m-%d') AS date FROM p")
def snk05_star_tweets(s, d):
    """SNK05: the fact relation of the star schema as it is written, with its partition column."""
    return _posts(s, d).select("tweet_id", "user_id", "cluster_id", "created_at", "retweet_count_at_collection", "likes_at_collection", "passes_claim_gate", F.date_format("created_at", "yyyy-MM-dd").alias("date"))
