"""Profiling: scans, projections and aggregations over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions import maths as M
from tideline.functions import time as T
from tideline.plans._register import Plans
from tideline.sources.tables import table

PLANS = Plans()


@PLANS("""SELECT count(*) AS n, min(likes_at_collection) AS low, max(likes_at_collection) AS high, CAST(sum(likes_at_collection) AS BIGINT) AS total,
round(avg(likes_at_collection), 6) AS mean, count(DISTINCT user_id) AS users, count(DISTINCT tweet_id) AS tweets FROM tweets""")
def ag01_basic_stats(s, d):
    likes = F.col("likes_at_collection")
    return table(s, d, "tweets").agg(F.count("*").alias("n"), F.min(likes).alias("low"), F.max(likes).alias("high"), F.sum(likes).alias("total"), F.round(F.avg(likes), 6).alias("mean"), F.count_distinct("user_id").alias("users"), F.count_distinct("tweet_id").alias("tweets"))


@PLANS("SELECT source, count(*) AS n FROM tweets GROUP BY source ORDER BY n DESC, source LIMIT 10")
def ag02_top_clients(s, d):
    return table(s, d, "tweets").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@PLANS("SELECT year(created_at) AS y, month(created_at) AS m, count(*) AS n, count(DISTINCT user_id) AS users, CAST(sum(retweet_count_at_collection) AS BIGINT) AS retweets FROM tweets GROUP BY 1, 2")
def ag03_by_month(s, d):
    t = table(s, d, "tweets")
    return t.groupBy(F.year("created_at").cast("bigint").alias("y"), F.month("created_at").cast("bigint").alias("m")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.sum("retweet_count_at_collection").alias("retweets"))


@PLANS("SELECT hour(created_at) AS h, count(*) AS n, round(avg(likes_at_collection), 6) AS likes FROM tweets GROUP BY 1")
def ag03_by_hour(s, d):
    return table(s, d, "tweets").groupBy(F.hour("created_at").cast("bigint").alias("h")).agg(F.count("*").alias("n"), F.round(F.avg("likes_at_collection"), 6).alias("likes"))


@PLANS("SELECT isodow(created_at) AS weekday, count(*) AS n FROM tweets GROUP BY 1")
def ag03_by_weekday(s, d):
    return table(s, d, "tweets").groupBy(T.iso_weekday(F.col("created_at")).cast("bigint").alias("weekday")).agg(F.count("*").alias("n"))


@PLANS("SELECT source, n, round(100.0 * n / sum(n) OVER (), 6) AS pct FROM (SELECT source, count(*) AS n FROM tweets GROUP BY source)")
def ag04_percent_of_total(s, d):
    c = table(s, d, "tweets").groupBy("source").agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))  # one row, joined rather than one window over everything
    return c.join(F.broadcast(total)).select("source", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("pct"))


@PLANS("SELECT strftime(created_at, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS users, count(DISTINCT cluster_id) AS clusters FROM tweets GROUP BY 1")
def ag05_distinct_by_day(s, d):
    return table(s, d, "tweets").groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count_distinct("user_id").alias("users"), F.count_distinct("cluster_id").alias("clusters"))


@PLANS("SELECT n AS tweets_per_user, count(*) AS users FROM (SELECT user_id, count(*) AS n FROM tweets GROUP BY user_id) GROUP BY n")
def ag06_size_of_sizes(s, d):
    return table(s, d, "tweets").groupBy("user_id").agg(F.count("*").alias("n")).groupBy(F.col("n").alias("tweets_per_user")).agg(F.count("*").alias("users"))


@PLANS("""WITH u AS (SELECT user_id, count(*) AS n FROM tweets GROUP BY user_id),
r AS (SELECT n, row_number() OVER (ORDER BY n, user_id) - 1 AS i, count(*) OVER () AS c FROM u)
SELECT CAST(q AS DOUBLE) AS q, min(n) AS value FROM r, (VALUES (0.25), (0.5), (0.75), (0.95), (0.99)) AS t(q) WHERE i = CAST(floor((c - 1) * q + 0.5) AS BIGINT) GROUP BY q""")
def ag07_quantiles_nearest(s, d):
    u = table(s, d, "tweets").groupBy("user_id").agg(F.count("*").alias("n"))
    # nearest-rank quantiles from a histogram of values: the sorted rows are never gathered, only distinct values are
    h = u.groupBy("n").agg(F.count("*").alias("c"))
    upto = h.withColumn("till", F.sum("c").over(Window.orderBy("n"))).withColumn("from", F.col("till") - F.col("c"))
    total = u.agg(F.count("*").alias("total"))
    q = s.createDataFrame([(0.25,), (0.5,), (0.75,), (0.95,), (0.99,)], "q double")
    at = F.floor((F.col("total") - 1) * F.col("q") + 0.5)
    return upto.join(F.broadcast(total)).join(F.broadcast(q), (at >= F.col("from")) & (at < F.col("till"))).select("q", F.col("n").alias("value"))


@PLANS("SELECT source, median(likes_at_collection) AS mid, quantile_cont(retweet_count_at_collection, 0.9) AS p90 FROM tweets GROUP BY source")
def ag08_median(s, d):
    return table(s, d, "tweets").groupBy("source").agg(F.median("likes_at_collection").alias("mid"), F.percentile("retweet_count_at_collection", F.lit(0.9)).alias("p90"))


@PLANS("SELECT count(*) FILTER (likes_at_collection > 0) AS liked, count(*) FILTER (retweet_count_at_collection > 0) AS retweeted, count(*) FILTER (lat IS NOT NULL AND NOT isnan(lat)) AS placed FROM tweets")
def ag09_conditional_counts(s, d):
    return table(s, d, "tweets").agg(F.count_if(F.col("likes_at_collection") > 0).alias("liked"), F.count_if(F.col("retweet_count_at_collection") > 0).alias("retweeted"), F.count_if(F.col("lat").isNotNull() & ~F.isnan("lat")).alias("placed"))


@PLANS("SELECT source, round(avg(CAST(user_verified AS INT)), 6) AS verified, round(avg(CAST(passes_claim_gate AS INT)), 6) AS gated FROM tweets GROUP BY source")
def ag10_ratios(s, d):
    return table(s, d, "tweets").groupBy("source").agg(F.round(F.avg(F.col("user_verified").cast("int")), 6).alias("verified"), F.round(F.avg(F.col("passes_claim_gate").cast("int")), 6).alias("gated"))


@PLANS("""SELECT 'likes_at_collection' AS name, count(likes_at_collection) AS n, count(DISTINCT likes_at_collection) AS kinds, CAST(min(likes_at_collection) AS VARCHAR) AS low, CAST(max(likes_at_collection) AS VARCHAR) AS high FROM tweets
UNION ALL SELECT 'user_verified', count(user_verified), count(DISTINCT user_verified), CAST(min(user_verified) AS VARCHAR), CAST(max(user_verified) AS VARCHAR) FROM tweets
UNION ALL SELECT 'text', count(text), count(DISTINCT text), CAST(min(strlen(text)) AS VARCHAR), CAST(max(strlen(text)) AS VARCHAR) FROM tweets""")
def ag11_profile(s, d):
    from tideline.operators.aggregates import profile

    return profile(table(s, d, "tweets"), ["likes_at_collection", "user_verified", "text"])


@PLANS("""SELECT name, nulls, round(100.0 * nulls / n, 6) AS pct FROM (SELECT count(*) AS n, count(*) - count(city) AS city, count(*) - count(country) AS country, count(*) - count(cluster_id) AS cluster_id, count(*) - count(user_name) AS user_name FROM tweets)
UNPIVOT (nulls FOR name IN (city, country, cluster_id, user_name))""")
def ag12_null_counts(s, d):
    from tideline.operators.aggregates import null_counts

    return null_counts(table(s, d, "tweets"), ["city", "country", "cluster_id", "user_name"])


@PLANS("SELECT label, split, count(*) AS n FROM normalizations GROUP BY label, split")
def ag25_label_counts(s, d):
    return table(s, d, "normalizations").groupBy("label", "split").agg(F.count("*").alias("n"))


@PLANS("SELECT sentence_id, count(DISTINCT lower(true_label)) AS labels FROM predictions GROUP BY sentence_id HAVING count(DISTINCT lower(true_label)) > 1")
def ag26_conflicting_labels(s, d):
    return table(s, d, "predictions").groupBy("sentence_id").agg(F.count_distinct(F.lower("true_label")).alias("labels")).where("labels > 1")


@PLANS("SELECT model, count(*) AS total, count(*) FILTER (confidence < 60) AS hard, round(100.0 * count(*) FILTER (confidence < 60) / count(*), 6) AS hard_pct FROM predictions GROUP BY model ORDER BY hard_pct DESC, model")
def ag27_hardness(s, d):
    hard = F.count_if(F.col("confidence") < 60)
    return table(s, d, "predictions").groupBy("model").agg(F.count("*").alias("total"), hard.alias("hard"), F.round(100.0 * hard / F.count("*"), 6).alias("hard_pct")).orderBy(F.desc("hard_pct"), "model")


@PLANS("SELECT day(d) AS dom, count(*) AS days, CAST(sum(n) AS BIGINT) AS tweets FROM (SELECT CAST(created_at AS DATE) AS d, count(*) AS n FROM tweets GROUP BY 1) GROUP BY 1")
def ag28_days_by_dom(s, d):
    daily = table(s, d, "tweets").groupBy(F.to_date("created_at").alias("d")).agg(F.count("*").alias("n"))
    return daily.groupBy(F.dayofmonth("d").cast("bigint").alias("dom")).agg(F.count("*").alias("days"), F.sum("n").alias("tweets"))


@PLANS("""SELECT count(DISTINCT date_trunc('hour', created_at)) AS filled, date_diff('hour', date_trunc('hour', min(created_at)), date_trunc('hour', max(created_at))) + 1 AS hours,
round(count(DISTINCT date_trunc('hour', created_at)) / (date_diff('hour', date_trunc('hour', min(created_at)), date_trunc('hour', max(created_at))) + 1.0), 6) AS coverage FROM tweets""")
def ag29_coverage(s, d):
    hour = F.date_trunc("hour", "created_at")
    span = table(s, d, "tweets").groupBy(hour.alias("h")).count().agg(F.count("*").alias("filled"), F.min("h").alias("a"), F.max("h").alias("b"))
    hours = F.timestamp_diff("HOUR", F.col("a"), F.col("b")) + 1
    return span.select("filled", hours.alias("hours"), F.round(F.col("filled") / hours, 6).alias("coverage"))


@PLANS("""WITH c AS (SELECT lower(true_label) AS a, lower(predicted_label) AS b, count(*) AS o FROM predictions WHERE true_label IS NOT NULL AND predicted_label IS NOT NULL GROUP BY 1, 2),
e AS (SELECT r.a, k.b, r.n * k.n / t.n AS e FROM (SELECT a, CAST(sum(o) AS DOUBLE) AS n FROM c GROUP BY a) r, (SELECT b, CAST(sum(o) AS DOUBLE) AS n FROM c GROUP BY b) k, (SELECT CAST(sum(o) AS DOUBLE) AS n FROM c) t)
SELECT round(sum((coalesce(o, 0) - e) * (coalesce(o, 0) - e) / e), 6) AS chi2, CAST((count(DISTINCT e.a) - 1) * (count(DISTINCT e.b) - 1) AS BIGINT) AS dof FROM e LEFT JOIN c ON c.a = e.a AND c.b = e.b""")
def ag30_chi_square(s, d):
    from tideline.operators.evaluate import chi_square

    p = table(s, d, "predictions").select(F.lower("true_label").alias("a"), F.lower("predicted_label").alias("b"))
    return chi_square(p, "a", "b")


@PLANS("""WITH c AS (SELECT source, split, count(*) AS n FROM normalizations WHERE source IS NOT NULL GROUP BY 1, 2), t AS (SELECT split, sum(n) AS st FROM c GROUP BY split), g AS (SELECT source, sum(n) AS gt FROM c GROUP BY source), a AS (SELECT sum(n) AS total FROM c)
SELECT c.source, c.split, n, round(100.0 * n / gt, 6) AS raw_pct, round((n / st) / (gt / total), 6) AS lift, (n / st) > 3 * (gt / total) AS over FROM c JOIN t USING (split) JOIN g USING (source), a""")
def ag31_split_share(s, d):
    from tideline.operators.aggregates import split_share

    return split_share(table(s, d, "normalizations").where("source is not null"), "source", "split")


@PLANS("SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM normalizations) WHERE length(word) > 3 AND word NOT IN ('this', 'that', 'with', 'from', 'have', 'were', 'they', 'your') GROUP BY word ORDER BY n DESC, word LIMIT 25")
def ag36_word_frequency(s, d):
    words = table(s, d, "normalizations").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    stop = ["this", "that", "with", "from", "have", "were", "they", "your"]
    return words.where((F.length("word") > 3) & ~F.col("word").isin(stop)).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(25)


@PLANS("""SELECT model_name, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS tokens_in, CAST(sum(output_tokens) AS BIGINT) AS tokens_out, round(avg(latency_ms), 4) AS mean_ms, round(stddev_samp(latency_ms), 4) AS std_ms, round(median(latency_ms), 4) AS median_ms, min(latency_ms) AS low_ms, max(latency_ms) AS high_ms FROM normalizations GROUP BY model_name""")
def ag37_usage(s, d):
    ms = F.col("latency_ms")
    return table(s, d, "normalizations").groupBy("model_name").agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("tokens_in"), F.sum("output_tokens").alias("tokens_out"), F.round(F.avg(ms), 4).alias("mean_ms"), F.round(F.stddev_samp(ms), 4).alias("std_ms"), F.round(F.median(ms), 4).alias("median_ms"), F.min(ms).alias("low_ms"), F.max(ms).alias("high_ms")
    )


@PLANS("SELECT sentence_id, confidence, CAST(trunc(confidence) AS BIGINT) AS whole, CASE WHEN confidence >= 75 THEN 'high' WHEN confidence >= 50 THEN 'mid' ELSE 'low' END AS band, coalesce(confidence, 0.0) AS filled FROM predictions WHERE split IN ('dev', 'test')")
def prj_select_cast_case(s, d):
    """PRJ01-PRJ07: select, derived columns, casts, CASE, fill, IN."""
    c = F.col("confidence")
    return table(s, d, "predictions").where(F.col("split").isin("dev", "test")).select("sentence_id", "confidence", c.cast("bigint").alias("whole"), F.when(c >= 75, "high").when(c >= 50, "mid").otherwise("low").alias("band"), F.coalesce(c, F.lit(0.0)).alias("filled"))


@PLANS("SELECT tweet_id, created_at FROM tweets WHERE created_at >= TIMESTAMP '2020-08-10' AND created_at < TIMESTAMP '2020-08-12'")
def prj08_half_open_range(s, d):
    at = F.col("created_at")
    return table(s, d, "tweets").where((at >= F.lit("2020-08-10").cast("timestamp_ntz")) & (at < F.lit("2020-08-12").cast("timestamp_ntz"))).select("tweet_id", "created_at")


@PLANS("SELECT sentence_id, model_name, row_number() OVER (ORDER BY sentence_id, model_name) - 1 AS i, 'norm' AS tag FROM (SELECT DISTINCT sentence_id, model_name FROM normalizations)")
def prj10_row_index(s, d):
    from tideline.operators.ranking import row_index

    return row_index(table(s, d, "normalizations").select("sentence_id", "model_name").distinct(), ["sentence_id", "model_name"], "i").withColumn("tag", F.lit("norm"))


@PLANS("SELECT tweet_id, coalesce(try_cast(source AS BIGINT), -1) AS number, coalesce(user_screen_name, user_name, user_id) AS who, hashtag_source IS NOT NULL AND hashtag_source != '[]' AS tagged FROM tweets")
def prj13_coercion_and_aliases(s, d):
    """PRJ12-PRJ14: null and list tests, safe numbers, first of several columns."""
    return table(s, d, "tweets").select("tweet_id", F.coalesce(F.col("source").try_cast("bigint"), F.lit(-1)).alias("number"), F.coalesce("user_screen_name", "user_name", "user_id").alias("who"), (F.col("hashtag_source").isNotNull() & (F.col("hashtag_source") != "[]")).alias("tagged"))


@PLANS("SELECT tweet_id, retweet_count_at_collection AS rt FROM tweets ORDER BY rt DESC, tweet_id, collected_at LIMIT 20")
def sr02_global_top(s, d):
    return table(s, d, "tweets").orderBy(F.desc("retweet_count_at_collection"), "tweet_id", "collected_at").limit(20).select("tweet_id", F.col("retweet_count_at_collection").alias("rt"))


@PLANS("""SELECT label, sentence_id FROM (SELECT label, sentence_id, row_number() OVER (PARTITION BY label ORDER BY md5(sentence_id || '42'), sentence_id) AS k FROM (SELECT DISTINCT label, sentence_id FROM normalizations WHERE label IS NOT NULL)) WHERE k <= 50""")
def sr07_balanced_sample(s, d):
    """SR06, SR07, SNK07: seeded samples by hash order, the same on every cluster."""
    from tideline.operators.ranking import hashed_sample

    return hashed_sample(table(s, d, "normalizations").where("label is not null").select("label", "sentence_id").distinct(), ["label"], "sentence_id", 50, 42)


@PLANS("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(sentence_id), sentence_id) % 5 AS fold FROM (SELECT DISTINCT sentence_id, label FROM normalizations WHERE label IS NOT NULL)) SELECT fold, label, count(*) AS n FROM r GROUP BY fold, label""")
def st09_stratified_folds(s, d):
    from tideline.operators.ranking import folds

    one = table(s, d, "normalizations").where("label is not null").select("sentence_id", "label").distinct()
    return folds(one, "label", "sentence_id", 5).groupBy("fold", "label").agg(F.count("*").alias("n"))


@PLANS("SELECT tweet_id, created_at FROM (SELECT DISTINCT tweet_id, created_at FROM tweets) ORDER BY created_at, tweet_id LIMIT 100")
def snk06_first_by_time(s, d):
    return table(s, d, "tweets").select("tweet_id", "created_at").distinct().orderBy("created_at", "tweet_id").limit(100)


@PLANS("WITH a AS (SELECT vec_id, label, row_number() OVER (ORDER BY label, vec_id) - 1 AS i FROM embeddings), b AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) SELECT i, vec_id, label, doc_id, lang FROM a JOIN b USING (i)")
def prj11_side_by_side(s, d):
    """PRJ11: two frames put beside each other by the numbers of their rows."""
    from tideline.operators.ranking import row_index

    a = row_index(table(s, d, "embeddings").select("vec_id", "label"), ["label", "vec_id"])
    b = row_index(table(s, d, "documents").select("doc_id", "lang"), ["doc_id"])
    return a.join(b, "i").select("i", "vec_id", "label", "doc_id", "lang")


@PLANS("SELECT user_id, followers_at_collection AS followers, username, row_number() OVER (ORDER BY verified DESC NULLS LAST, followers_at_collection DESC NULLS LAST, user_id, username) - 1 AS place FROM (SELECT DISTINCT user_id, followers_at_collection, username, verified FROM users)")
def sr01_multi_key_sort(s, d):
    """SR01: an order by several keys in different directions; the place in it shows the order."""
    from tideline.operators.ranking import row_index

    u = table(s, d, "users").select("user_id", "followers_at_collection", "username", "verified").distinct()
    u = u.withColumn("_v", -F.coalesce(F.col("verified").cast("int"), F.lit(-1))).withColumn("_f", -F.coalesce("followers_at_collection", F.lit(-1)))
    return row_index(u, ["_v", "_f", "user_id", "username"], "place").select("user_id", F.col("followers_at_collection").alias("followers"), "username", "place")
