"""Spread of clusters: growth, gaps, concentration, scores, targets, event features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import maths as M
from tideline.operators import clusters as C
from tideline.operators import sessions as S
from tideline.operators import virality as V
from tideline.plans._register import Plans
from tideline.plans.clusters import _POSTS, _WINDOW, _posts
from tideline.plans.series import _E_STATS, _E_Z, _states
from tideline.sources.tables import table

PLANS = Plans()


@PLANS(f"""WITH {_POSTS}, {_WINDOW}, a AS (SELECT cluster_id, t, n::DOUBLE AS v, row_number() OVER q AS i, count(*) OVER (PARTITION BY cluster_id) AS n, n - lag(n) OVER q AS d1 FROM w WINDOW q AS (PARTITION BY cluster_id ORDER BY t)), b AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY cluster_id ORDER BY t) AS d2 FROM a),
g AS (SELECT cluster_id, count(*) AS points, arg_min(v, i) AS f, arg_max(v, i) AS l, max(v) AS peak, min(i) FILTER (v = mv) AS pk, avg(abs(d1)) AS v1, avg(abs(d2)) AS v2, sum(v) FILTER (i <= greatest(1, n // 4)) AS e, sum(v) AS s FROM (SELECT *, max(v) OVER (PARTITION BY cluster_id) AS mv FROM b) GROUP BY cluster_id)
SELECT cluster_id, points, round((l - f) / greatest(1.0, f), 6) AS growth_rate, round(coalesce(v1, 0), 6) AS velocity, round(coalesce(v2, 0), 6) AS jerk, peak, round((pk - 1) / greatest(points - 1, 1)::DOUBLE, 6) AS peak_position, pk < points AS is_post_peak, round(e / greatest(s, 1.0), 6) AS early_ratio, round(l / greatest(peak, 1.0), 6) AS final_ratio FROM g""")
def ud03_growth(s, d):
    """UD03 with WN16, WN18, WN19: growth group of the features."""
    return V.growth(C.window_stats(_posts(s, d)))


@PLANS(f"""WITH {_POSTS}, g AS (SELECT cluster_id, date_diff('second', lag(c) OVER q, c) AS gap FROM (SELECT cluster_id, tweet_id, date_trunc('second', created_at) AS c FROM p) WINDOW q AS (PARTITION BY cluster_id ORDER BY c, tweet_id))
SELECT cluster_id, count(*) AS gaps, round(avg(gap), 4) AS mean_gap, round(stddev_pop(gap), 4) AS std_gap, round(CASE WHEN avg(gap) = 0 THEN 0 ELSE stddev_pop(gap) / avg(gap) END, 6) AS cv, round(CASE WHEN count(*) < 2 OR avg(gap) + stddev_pop(gap) = 0 THEN 0 ELSE (stddev_pop(gap) - avg(gap)) / (stddev_pop(gap) + avg(gap)) END, 6) AS burstiness FROM g WHERE gap IS NOT NULL GROUP BY cluster_id""")
def wn17_cluster_gaps(s, d):
    """WN17: times between a cluster's posts."""
    return V.gaps(_posts(s, d).withColumn("c", F.date_trunc("second", "created_at").cast("timestamp_ntz")), "cluster_id", "c", "tweet_id")


@PLANS("""WITH g AS (SELECT user_id, date_diff('second', lag(t) OVER q, t) AS gap FROM (SELECT user_id, event_id, date_trunc('second', ts) AS t FROM events) WINDOW q AS (PARTITION BY user_id ORDER BY t, event_id)), a AS (SELECT user_id, count(*) AS gaps, avg(gap) AS m, stddev_pop(gap) AS sd FROM g WHERE gap IS NOT NULL GROUP BY 1)
SELECT user_id, gaps, round(m, 4) AS mean_gap, round(sd, 4) AS std_gap, round(CASE WHEN m = 0 THEN 0 ELSE sd / m END, 6) AS cv, round(CASE WHEN gaps < 2 OR m + sd = 0 THEN 0 ELSE (sd - m) / (sd + m) END, 6) AS burstiness FROM a""")
def ma04_burstiness(s, d):
    """MA04, WN17."""
    e = table(s, d, "events").select("user_id", "event_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("t"))
    return V.gaps(e, "user_id", "t", "event_id")


@PLANS("WITH c AS (SELECT event_type, hour(ts) AS h, count(*) AS c FROM events GROUP BY 1, 2), n AS (SELECT event_type, sum(c) AS n, count(*) AS k FROM c GROUP BY 1) SELECT event_type, round(sum(-(c / n + 1e-10) * ln(c / n + 1e-10)) + (24 - max(k)) * (-1e-10 * ln(1e-10)), 6) AS entropy FROM c JOIN n USING (event_type) GROUP BY event_type")
def ma05_hour_entropy(s, d):
    return V.smoothed_entropy(table(s, d, "events").select("event_type", F.hour("ts").alias("h")), "event_type", "h", 24)


@PLANS(f"WITH {_POSTS}, c AS (SELECT cluster_id, country, count(*) AS c FROM p WHERE country IS NOT NULL GROUP BY 1, 2), n AS (SELECT cluster_id, sum(c) AS n FROM c GROUP BY 1) SELECT cluster_id, round(sum(-(c / n + 1e-10) * ln(c / n + 1e-10)), 6) AS entropy FROM c JOIN n USING (cluster_id) GROUP BY cluster_id")
def ma06_geo_entropy(s, d):
    return V.smoothed_entropy(_posts(s, d), "cluster_id", "country")


@PLANS(f"WITH {_POSTS}, u AS (SELECT cluster_id, user_id, count(*) AS c FROM p WHERE user_id IS NOT NULL GROUP BY 1, 2) SELECT cluster_id, round(sum(c) / count(*), 6) AS per_user, round(max(c) / sum(c), 6) AS top_share, round(count(*) FILTER (c = 1) / count(*), 6) AS single_share FROM u GROUP BY 1")
def ud03_concentration(s, d):
    return V.concentration(_posts(s, d), "cluster_id", "user_id")


def _detected(s, d, hours=24):
    """Posts of clusters in the features' columns, and detection ``hours`` after the first post."""
    p = _posts(s, d)
    columns = {"cluster_id": "entity", "tweet_id": "post", "user_id": "user", "created_at": "at", "retweet_count_at_collection": "retweets", "likes_at_collection": "likes", "user_followers_count": "followers", "country": "country", "user_join_date": "joined"}
    p = p.select(*[F.col(a).alias(b) for a, b in columns.items()])
    return p, p.groupBy("entity").agg(F.timestamp_add("HOUR", F.lit(hours), F.min("at")).alias("detect_at"))


_DETECTED = "f AS (SELECT cluster_id, min(created_at) + INTERVAL 24 HOUR AS d FROM p GROUP BY 1), x AS (SELECT cluster_id AS entity, tweet_id, user_id, created_at AS ts, d, country, user_join_date AS joined, user_followers_count AS fol, coalesce(retweet_count_at_collection, 0) AS rt, coalesce(likes_at_collection, 0) AS lk, coalesce(retweet_count_at_collection, 0) + coalesce(likes_at_collection, 0) AS eng FROM p JOIN f USING (cluster_id) WHERE created_at <= d)"
_DETECTED_HOURS = f"b AS (SELECT entity, date_trunc('hour', ts)::TIMESTAMP AS t, count(*) AS n, CAST(sum(eng) AS BIGINT) AS e, count(DISTINCT user_id) AS users, coalesce(avg(fol), 0) AS mf, coalesce(max(fol), 0) AS xf FROM x GROUP BY 1, 2), {_E_STATS}, {_E_Z}"
_GINI = "(SELECT entity, round(CASE WHEN sum(v) = 0 THEN 0 ELSE (2 * sum(v * r) - (count(*) + 1) * sum(v)) / (count(*) * sum(v)) END, 6) AS gini FROM (SELECT entity, v, row_number() OVER (PARTITION BY entity ORDER BY v) AS r FROM {}) GROUP BY 1)"


@PLANS(f"""WITH {_POSTS}, {_DETECTED}, {_DETECTED_HOURS},
s AS (SELECT *, row_number() OVER q AS i, count(*) OVER (PARTITION BY entity) AS k, e - lag(e) OVER q AS d1, max(e) OVER (PARTITION BY entity) AS me, round(0.4 * zn + 0.6 * ze, 6) AS zz FROM z WINDOW q AS (PARTITION BY entity ORDER BY t)), s2 AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY entity ORDER BY t) AS d2 FROM s),
g AS (SELECT entity, max(k) AS k, sum(n) AS tw, sum(e) AS e, arg_max(e, i) AS l, arg_min(e, i) AS f, min(i) FILTER (e = me) AS pk, arg_max(d1, i) FILTER (d1 IS NOT NULL) AS dl, arg_min(d1, i) FILTER (d1 IS NOT NULL) AS df, avg(abs(d1)) AS v, avg(abs(d2)) AS j, coalesce(sum(e) FILTER (i <= greatest(1, k // 4)), 0) AS early, max(xf) AS xf, avg(mf) AS mf, sum(users) AS us, arg_max(zz, t) AS zd, max(zz) AS zx, arg_max(round(zn, 6), t) AS zc, arg_max(round(ze, 6), t) AS zg FROM s2 GROUP BY entity),
mm AS (SELECT entity, avg(eng) AS m1 FROM x GROUP BY 1), m AS (SELECT x.entity, stddev_pop(eng) AS sd, avg((eng - m1) * (eng - m1)) AS m2, avg((eng - m1) * (eng - m1) * (eng - m1)) AS m3, sum(rt) AS rt, sum(lk) AS lk, max(rt) AS xr, avg(lk) AS ml, avg(floor(date_diff('second', date_trunc('second', joined), date_trunc('second', ts)) / 86400.0)) AS age, max(d) AS d FROM x JOIN mm USING (entity) GROUP BY 1),
gp AS (SELECT entity, count(*) AS gaps, avg(gap) AS mg, stddev_pop(gap) AS sg FROM (SELECT entity, date_diff('second', lag(q) OVER w, q) AS gap FROM (SELECT entity, tweet_id, date_trunc('second', ts) AS q FROM x) WINDOW w AS (PARTITION BY entity ORDER BY q, tweet_id)) WHERE gap IS NOT NULL GROUP BY 1),
ge AS (SELECT entity, sum(-h * ln(h + 1e-10)) AS ge, count(*) AS nc FROM (SELECT entity, count(*) / sum(count(*)) OVER (PARTITION BY entity) AS h FROM x WHERE country IS NOT NULL GROUP BY entity, country) GROUP BY 1), ho AS (SELECT entity, sum(-h * ln(h + 1e-10)) AS ho FROM (SELECT entity, count(*) / sum(count(*)) OVER (PARTITION BY entity) AS h FROM x GROUP BY entity, hour(ts)) GROUP BY 1),
u AS (SELECT entity, count(*) AS v FROM x GROUP BY entity, user_id), tu AS (SELECT entity, max(v) / sum(v) AS tu FROM u GROUP BY 1), g1 AS {_GINI.format("(SELECT entity, eng AS v FROM x)")}, g2 AS {_GINI.format("u")}
SELECT g.entity, round(tw, 6)::DOUBLE AS cumulative_tweets, g.e::DOUBLE AS cumulative_engagement, k::DOUBLE AS windows_since_start, round(tw / k, 6) AS mean_tweets_per_window, round(g.e / k, 6) AS mean_engagement_per_window, round(CASE WHEN k >= 2 THEN l / greatest(1.0, f) ELSE 1 END, 6) AS growth_rate, CASE WHEN k >= 3 THEN dl - df ELSE 0 END::DOUBLE AS acceleration, round(CASE WHEN k >= 3 THEN v ELSE 0 END, 6) AS engagement_velocity, round(CASE WHEN k >= 3 THEN j ELSE 0 END, 6) AS engagement_jerk,
round(CASE WHEN gaps >= 2 AND mg + sg > 0 THEN (sg - mg) / (sg + mg) ELSE 0 END, 6) AS burstiness, round(CASE WHEN gaps >= 2 THEN mg ELSE 0 END, 4) AS inter_arrival_mean, round(CASE WHEN gaps >= 2 THEN sg ELSE 0 END, 4) AS inter_arrival_std, round(CASE WHEN gaps >= 2 AND mg > 0 THEN sg / mg ELSE 0 END, 6) AS inter_arrival_cv,
round(CASE WHEN k >= 2 THEN early / greatest(1.0, g.e) ELSE 1 END, 6) AS early_velocity_ratio, round(CASE WHEN k >= 2 THEN l / greatest(1.0, g.e) ELSE 1 END, 6) AS final_window_ratio, CASE WHEN k >= 2 AND pk < k THEN 1.0 ELSE 0.0 END AS is_post_peak, round(CASE WHEN k >= 2 THEN (pk - 1) / greatest(1.0, k - 1) ELSE 1 END, 6) AS peak_position_ratio, xf::DOUBLE AS max_followers_seen, round(mf, 6) AS avg_followers_seen, us::DOUBLE AS total_unique_users, round(g.e / greatest(1.0, mf * us), 6) AS engagement_per_follower, round(rt / greatest(1.0, us), 6) AS amplification_factor,
zd AS z_score_at_detect, zx AS max_z_score_seen, zc AS z_score_count_at_detect, zg AS z_score_engagement_at_detect, round(coalesce(ge, 0), 6) AS geographic_entropy_predetect, coalesce(nc, 0)::DOUBLE AS unique_countries_predetect, hour(d)::DOUBLE AS hour_of_day, CASE WHEN dayofweek(d) IN (0, 6) THEN 1.0 ELSE 0.0 END AS is_weekend, CASE WHEN hour(d) BETWEEN 6 AND 11 THEN 1.0 ELSE 0.0 END AS is_morning, CASE WHEN hour(d) >= 18 THEN 1.0 ELSE 0.0 END AS is_evening, round(ho, 6) AS posting_hour_entropy,
xr::DOUBLE AS max_retweets_per_tweet, round(ml, 6) AS avg_likes_per_tweet, round(rt / greatest(1.0, lk), 6) AS rt_like_ratio, round(CASE WHEN sd > 0 THEN m3 / pow(m2, 1.5) ELSE 0 END, 6) AS engagement_skewness, g1.gini AS engagement_gini, g2.gini AS user_gini, round(tu, 6) AS top_user_ratio, round(coalesce(age, 0), 6) AS account_age_avg_days
FROM g JOIN m USING (entity) LEFT JOIN gp USING (entity) LEFT JOIN ge USING (entity) LEFT JOIN ho USING (entity) LEFT JOIN tu USING (entity) LEFT JOIN g1 USING (entity) LEFT JOIN g2 USING (entity)""")
def ud03_features(s, d):
    """UD03: all features but the burst state (`ud03_burst_at_detect`), from posts up to the detection only."""
    return V.features(*_detected(s, d), states=False)


@PLANS(f"WITH RECURSIVE {_POSTS}, {_DETECTED}, {_DETECTED_HOURS}, {_states('true')} SELECT entity, arg_max(state, i)::DOUBLE AS kleinberg_state_at_detect FROM k GROUP BY entity")
def ud03_burst_at_detect(s, d):
    return V.features(*_detected(s, d)).select("entity", "kleinberg_state_at_detect")


@PLANS(f"""WITH {_POSTS}, {_DETECTED}, {_DETECTED_HOURS}, zd AS (SELECT entity, arg_max(round(0.4 * zn + 0.6 * ze, 6), t) AS z FROM z GROUP BY 1), g AS (SELECT entity, count(*) / greatest(1.0, date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) / 3600.0) AS v, coalesce(max(fol), 0) AS f FROM x GROUP BY 1),
s AS (SELECT entity, z, least(greatest(0.3 + CASE WHEN v > 100 THEN 0.2 ELSE 0 END + CASE WHEN f > 10000 THEN 0.2 ELSE 0 END + CASE WHEN z > 5 THEN 0.15 ELSE 0 END, 0.05), 0.95) AS s FROM g JOIN zd USING (entity))
SELECT entity AS cluster_id, round(z, 4) AS z, round(s, 6) AS score, s > 0.5 AS is_viral FROM s""")
def ud04_virality_score(s, d):
    """UD04: heuristic score at detection, with the cluster's own score at that time."""
    p, detected = _detected(s, d)
    z = V.features(p, detected, states=False).select("entity", F.col("z_score_at_detect").alias("z"))
    p = p.join(detected, "entity").where(F.col("at") <= F.col("detect_at"))
    g = p.groupBy("entity").agg(F.count("*").alias("n"), F.min("at").alias("a"), F.max("at").alias("b"), F.coalesce(F.max("followers"), F.lit(0)).alias("f")).join(z, "entity")
    cut = lambda c: F.date_trunc("second", c).cast("timestamp_ntz")
    hours = F.greatest(F.lit(1.0), F.timestamp_diff("SECOND", cut("a"), cut("b")) / 3600.0)
    score = M.virality_score(F.col("n") / hours, F.col("f"), F.col("z"))
    return g.select(F.col("entity").alias("cluster_id"), F.round("z", 4).alias("z"), F.round(score, 6).alias("score"), (score > 0.5).alias("is_viral"))


@PLANS(f"""WITH {_POSTS}, f AS (SELECT cluster_id, min(created_at) AS f FROM p GROUP BY 1), g AS (SELECT p.cluster_id, CAST(sum(retweet_count_at_collection + likes_at_collection) AS BIGINT) AS final, CAST(sum(CASE WHEN created_at <= f + INTERVAL 6 HOUR THEN retweet_count_at_collection + likes_at_collection ELSE 0 END) AS BIGINT) AS detected FROM p JOIN f USING (cluster_id) GROUP BY 1)
SELECT cluster_id, final, detected, round(CASE WHEN final = 0 THEN 1.0 ELSE (final - detected) / final END, 6) AS psr FROM g""")
def ud05_potential(s, d):
    return V.potential(_posts(s, d), "cluster_id", "created_at", F.col("retweet_count_at_collection") + F.col("likes_at_collection"))


_X = """e AS (SELECT user_id, ts, floor(value) AS v, CASE WHEN lag(ts) OVER w IS NULL THEN 0 WHEN ts > lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, floor(value))), se AS (SELECT *, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, v ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM e), x AS (SELECT user_id, session, min(ts) AS start, count(*) AS n FROM se GROUP BY 1, 2),
j AS (SELECT x.user_id, x.session, count(f.ts) FILTER (f.ts < x.start + INTERVAL 6 HOUR) AS peek, count(f.ts) FILTER (f.ts >= x.start + INTERVAL 6 HOUR) AS later FROM x LEFT JOIN events f ON f.user_id = x.user_id AND f.ts >= x.start AND f.ts < x.start + INTERVAL 174 HOUR GROUP BY 1, 2)"""


@PLANS(f"WITH {_X} SELECT user_id, session, peek, later, later >= (SELECT median(later) FROM j) AS popular FROM j")
def ud06_popular_events(s, d):
    """UD06, SR09: event features and the median-split target."""
    e = table(s, d, "events").select("user_id", "ts", F.floor("value").cast("bigint").alias("v"))
    f = S.peek_and_horizon(S.events(e, "user_id", "ts", "v"), e, "user_id", "ts", "v")
    mid = f.agg(F.median("later_n").alias("m"))
    return f.join(F.broadcast(mid)).select("user_id", "session", F.col("peek_n").alias("peek"), F.col("later_n").alias("later"), (F.col("later_n") >= F.col("m")).alias("popular"))


@PLANS(f"""WITH {_POSTS}, e AS (SELECT cluster_id, created_at AS ts, text, coalesce(retweet_count_at_collection, 0) AS rt, coalesce(likes_at_collection, 0) AS lk FROM p WHERE created_at IS NOT NULL), br AS (SELECT *, rt + lk AS eng, CASE WHEN lag(ts) OVER w IS NULL THEN 0 WHEN ts > lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM e WINDOW w AS (PARTITION BY cluster_id ORDER BY ts, rt + lk)),
se AS (SELECT *, CAST(sum(b) OVER (PARTITION BY cluster_id ORDER BY ts, eng ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM br), st AS (SELECT *, min(ts) OVER (PARTITION BY cluster_id, session) AS start FROM se), x AS (SELECT cluster_id, session, start, min(eng) FILTER (ts = start) AS first_score, max(eng) AS max_score FROM st GROUP BY 1, 2, 3),
j AS (SELECT x.*, f.rt, f.eng, f.text, f.ts < start + INTERVAL 6 HOUR AS early, f.ts < start + INTERVAL 3 HOUR AS half FROM x JOIN br f ON f.cluster_id = x.cluster_id AND f.ts >= start AND f.ts < start + INTERVAL 174 HOUR),
g AS (SELECT cluster_id, session, start, first_score, max_score, count(*) FILTER (early) AS n, coalesce(sum(eng) FILTER (early), 0) AS e, coalesce(sum(eng) FILTER (early AND half), 0) AS e1, count(*) FILTER (early AND half) AS n1, coalesce(sum(eng) FILTER (early AND NOT half), 0) AS e2, count(*) FILTER (early AND NOT half) AS n2, coalesce(sum(rt) FILTER (early), 0) AS rt, sum(len(text) - len(replace(text, '#', ''))) FILTER (early) AS ht, count(*) FILTER (early AND contains(text, 'http')) AS url, count(*) FILTER (early AND starts_with(text, 'RT @')) AS re, coalesce(sum(eng) FILTER (NOT early), 0) AS later FROM j GROUP BY 1, 2, 3, 4, 5)
SELECT cluster_id, session, first_score::DOUBLE AS z_score_at_detection, max_score::DOUBLE AS z_max_peek, round(e2 / greatest(n2, 1) - e1 / greatest(n1, 1), 6) AS momentum, round(rt / greatest(e, 1), 6) AS rt_ratio, 0.0 AS reply_ratio, round(e / n, 6) AS engagement_efficiency, n AS tweet_volume, round(url / n, 6) AS url_density, 0.0 AS media_density, 0.0 AS video_density, round(coalesce(ht, 0) / n, 6) AS hashtag_avg, 0.0 AS quote_ratio, round(re / n, 6) AS retweet_ratio, hour(start) AS hour_of_day, CASE WHEN dayofweek(start) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend, later::DOUBLE AS horizon_engagement FROM g""")
def ud06_event_features(s, d):
    """UD06: the fifteen features of events of posts; engagement stands for the score, replies and media aren't in these tables."""
    p = _posts(s, d).where("created_at is not null").select(
        "cluster_id", "created_at", F.coalesce("retweet_count_at_collection", F.lit(0)).alias("retweets"), F.coalesce("likes_at_collection", F.lit(0)).alias("likes"), F.lit(0).alias("replies"), F.contains("text", F.lit("http")).alias("url"), F.lit(False).alias("photo"), F.lit(False).alias("video"), F.lit(False).alias("quote"), F.startswith("text", F.lit("RT @")).alias("retweet"), (F.length("text") - F.length(F.replace("text", F.lit("#"), F.lit("")))).alias("hashtags")
    )
    e = S.events(p.withColumn("score", F.col("retweets") + F.col("likes")), "cluster_id", "created_at", "score")
    return S.event_features(e, p, "cluster_id", "created_at")
