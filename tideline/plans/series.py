"""Time series: replay windows, resampling, anomalies, bursts, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import time as T
from tideline.operators import detect as D
from tideline.operators import sessions as S
from tideline.operators.ranking import time_split
from tideline.plans._register import Plans
from tideline.sources.tables import table

PLANS = Plans()


def _daily(s, d):
    return D.series(table(s, d, "events"), "event_type", "ts", "day")


def _hourly(s, d):
    return D.series(table(s, d, "events"), "event_type", "ts", "hour")


_DAY = "b AS (SELECT event_type AS entity, date_trunc('day', ts)::TIMESTAMP AS t, count(*) AS n FROM events GROUP BY 1, 2)"
_HOUR = "b AS (SELECT event_type AS entity, date_trunc('hour', ts)::TIMESTAMP AS t, count(*) AS n FROM events GROUP BY 1, 2)"


def _z(width: int, count: int, std: float, threshold: float | None, base: str = "b") -> str:
    cut = "" if threshold is None else f" AND round((n - m) / s, 6) > {threshold}"
    return f"SELECT entity, t, n, round((n - m) / s, 6) AS z, round(m, 6) AS mean, round(s, 6) AS std FROM (SELECT *, avg(n) OVER f AS m, stddev_pop(n) OVER f AS s, count(n) OVER f AS k FROM {base} WINDOW f AS (PARTITION BY entity ORDER BY t ROWS BETWEEN {width} PRECEDING AND 1 PRECEDING)) WHERE k = {width} AND n >= {count} AND s >= {std}{cut}"


@PLANS(f"WITH {_DAY} " + _z(7, 1, 0.5, None))
def wn01_z_daily_scored(s, d):
    return D.rolling_z(_daily(s, d), 7, 1, 0.5, None)


@PLANS(f"WITH {_HOUR} " + _z(24, 1, 0.5, 1.5))
def wn01_z_hourly_24(s, d):
    return D.rolling_z(_hourly(s, d), 24, 1, 0.5, 1.5)


@PLANS(f"WITH {_HOUR} SELECT entity, t, n, round((n - m) / s, 6) AS z, round(m, 6) AS mean, round(s, 6) AS std FROM (SELECT *, avg(n) OVER f AS m, stddev_pop(n) OVER f AS s, row_number() OVER (PARTITION BY entity ORDER BY t) AS k FROM b WINDOW f AS (PARTITION BY entity ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE k > 24 AND n >= 1 AND s >= 0.5 AND round((n - m) / s, 6) > 1.5")
def wn02_z_expanding(s, d):
    return D.expanding_z(_hourly(s, d), 24, 1, 0.5, 1.5)


@PLANS(f"""WITH {_HOUR}, dy AS (SELECT entity, date_trunc('day', t)::TIMESTAMP AS t, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY 1, 2), wk AS (SELECT entity, date_trunc('week', t)::TIMESTAMP AS t, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY 1, 2)
SELECT 'hourly_24' AS level, * FROM ({_z(24, 2, 0.5, 1.0)}) UNION ALL SELECT 'hourly_168', * FROM ({_z(168, 2, 0.5, 1.0)}) UNION ALL SELECT 'daily_30', * FROM ({_z(30, 2, 0.5, 1.0, "dy")}) UNION ALL
SELECT 'weekly_global', entity, t, n, round((n - m) / s, 6), round(m, 6), round(s, 6) FROM (SELECT *, avg(n) OVER f AS m, stddev_pop(n) OVER f AS s, row_number() OVER (PARTITION BY entity ORDER BY t) AS k FROM wk WINDOW f AS (PARTITION BY entity ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE k > 4 AND n >= 2 AND s >= 0.5 AND round((n - m) / s, 6) > 1.0""")
def wn03_z_all_levels(s, d):
    return D.all_levels(_hourly(s, d), 2, 0.5, 1.0)


@PLANS(f"WITH {_HOUR} SELECT entity, t, n, round(CASE WHEN k <= 24 OR s = 0 THEN 0.0 ELSE (n - m) / s END, 6) AS z FROM (SELECT *, avg(n) OVER f AS m, stddev_pop(n) OVER f AS s, row_number() OVER (PARTITION BY entity ORDER BY t) AS k FROM b WINDOW f AS (PARTITION BY entity ORDER BY t ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING))")
def wn04_z_heat(s, d):
    return D.heat_z(_hourly(s, d))


@PLANS("""WITH b AS (SELECT event_type AS entity, date_trunc('day', ts)::TIMESTAMP AS t, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS v FROM events GROUP BY 1, 2),
z AS (SELECT *, coalesce((n - avg(n) OVER p) / nullif(stddev_samp(n) OVER p, 0), 0) AS zc, coalesce((v - avg(v) OVER p) / nullif(stddev_samp(v) OVER p, 0), 0) AS ze FROM b WINDOW p AS (PARTITION BY entity))
SELECT entity, t, round(zc, 6) AS z_count, round(ze, 6) AS z_value, round(0.4 * round(zc, 6) + 0.6 * round(ze, 6), 5) AS score FROM z""")
def wn05_z_composite(s, d):
    """WN05, WN06, JN04: counts and engagement joined on two keys, scored over the whole series."""
    e = table(s, d, "events")
    n, v = D.series(e, "event_type", "ts", "day"), D.series(e, "event_type", "ts", "day", F.floor("value").cast("bigint")).withColumnRenamed("n", "v")
    z = D.partition_z(D.partition_z(n.join(v, ["entity", "t"]), "entity", "n", "z_count"), "entity", "v", "z_value")
    return z.select("entity", "t", "z_count", "z_value", F.round(0.4 * F.col("z_count") + 0.6 * F.col("z_value"), 5).alias("score"))


_STATS = "st AS (SELECT *, count(n) OVER f AS obs, CASE WHEN count(n) OVER f < 2 THEN 0.0 ELSE avg(n) OVER f END AS mean, CASE WHEN count(n) OVER f < 2 THEN 0.0 ELSE stddev_pop(n) OVER f END AS std FROM b WINDOW f AS (PARTITION BY entity ORDER BY t ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING))"


@PLANS(f"WITH {_HOUR}, {_STATS} SELECT entity, t, n, obs, round(mean, 6) AS mean, round(std, 6) AS std, round(CASE WHEN std < 1 THEN 0.0 ELSE (n - mean) / std END, 6) AS z FROM st")
def wn07_active_z(s, d):
    """WN07, WN08: trailing statistics over active rows and the mature score."""
    z = F.when(F.col("std") < 1, 0.0).otherwise((F.col("n") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0)))
    return D.active_stats(_hourly(s, d)).select("entity", "t", "n", "obs", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round(z, 6).alias("z"))


_SPARSE_SERIES = "b AS (SELECT cluster_id AS entity, date_trunc('day', created_at)::TIMESTAMP AS t, count(*) AS n FROM tweets WHERE cluster_id >= 0 GROUP BY 1, 2)"
_GLOBAL = "g AS (SELECT *, count(*) OVER r AS g, avg(n) OVER r AS gm, coalesce(stddev_samp(n) OVER r, 0) AS gs FROM st WHERE obs < 24 WINDOW r AS (ORDER BY t, entity ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"


def _cluster_days(s, d):
    return D.series(table(s, d, "tweets").where("cluster_id >= 0"), "cluster_id", "created_at", "day")


@PLANS(f"WITH {_SPARSE_SERIES}, {_STATS}, {_GLOBAL} SELECT entity, t, g, round(gm, 5) AS g_mean, round(gs, 5) AS g_std FROM g")
def wn09_global_running(s, d):
    return D.global_running(D.active_stats(_cluster_days(s, d))).select("entity", "t", "g", F.round("g_mean", 5).alias("g_mean"), F.round("g_std", 5).alias("g_std"))


@PLANS(f"""WITH {_SPARSE_SERIES}, {_STATS}, {_GLOBAL}, w AS (SELECT *, obs / (obs + 24.0) AS w FROM g WHERE g >= 100)
SELECT entity, t, n, obs, round(w, 6) AS weight, round((n - (w * mean + (1 - w) * gm)) / greatest(CASE WHEN obs < 3 THEN gs ELSE greatest(w * std + (1 - w) * gs, 0.5 * gs) END, 1.0), 6) AS z FROM w""")
def wn10_shrunk_z(s, d):
    return D.shrunk_z(D.active_stats(_cluster_days(s, d)))


def _states(rows: str) -> str:
    """The burst automaton as a recursive query over the rows picked from ``st``."""
    best = lambda prev: ", ".join(f"n * ln(r * {2 ** k}) - r * {2 ** k} - greatest({k} - ({prev}), 0)" for k in range(3))
    pick = lambda prev: f"list_position([{best(prev)}], list_max([{best(prev)}])) - 1"
    return f"""q AS (SELECT entity, t, n, greatest(mean, 1.0) AS r, row_number() OVER (PARTITION BY entity ORDER BY t) AS i FROM st WHERE {rows}),
    k AS (SELECT entity, t, n, i, CAST({pick("0")} AS INTEGER) AS state FROM q WHERE i = 1 UNION ALL SELECT q.entity, q.t, q.n, q.i, CAST({pick("k.state").replace("n * ", "q.n * ").replace("r * ", "q.r * ")} AS INTEGER) FROM k JOIN q ON q.entity = k.entity AND q.i = k.i + 1)"""


@PLANS(f"WITH RECURSIVE {_HOUR}, {_STATS}, {_states('obs >= 24')} SELECT entity, t, n, state FROM k")
def sm09_burst_states(s, d):
    """The fold over series; the SQL steps through them recursively."""
    return D.burst_states(D.active_stats(_hourly(s, d)))


_E_SERIES = "b AS (SELECT cluster_id AS entity, date_trunc('day', created_at)::TIMESTAMP AS t, count(*) AS n, CAST(coalesce(sum(retweet_count_at_collection + likes_at_collection), 0) AS BIGINT) AS e FROM tweets WHERE cluster_id >= 0 GROUP BY 1, 2)"
_E_STATS = "st AS (SELECT *, count(n) OVER f AS obs, " + ", ".join(f"CASE WHEN count(n) OVER f < 2 THEN 0.0 ELSE {f}({x}) OVER f END AS {c}" for f, x, c in (("avg", "n", "mean"), ("stddev_pop", "n", "std"), ("avg", "e", "mean_e"), ("stddev_pop", "e", "std_e"))) + " FROM b WINDOW f AS (PARTITION BY entity ORDER BY t ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING))"
_E_Z = "z AS (SELECT *, CASE WHEN std < CASE WHEN obs < 24 THEN 0.1 ELSE 2.0 END THEN 0.0 ELSE (n - mean) / std END AS zn, CASE WHEN std_e < CASE WHEN obs < 24 THEN 0.1 ELSE 5.0 END THEN 0.0 ELSE (e - mean_e) / std_e END AS ze FROM st)"
_E_COLD = """g AS (SELECT *, count(*) OVER r AS g, avg(n) OVER r AS gn, coalesce(stddev_samp(n) OVER r, 0) AS sn, avg(e) OVER r AS ge, coalesce(stddev_samp(e) OVER r, 0) AS se, obs / (obs + 24.0) AS w FROM st WHERE obs < 24 WINDOW r AS (ORDER BY t, entity ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT entity, t, round((n - (w * mean + (1 - w) * gn)) / greatest(CASE WHEN obs < 3 THEN sn ELSE greatest(w * std + (1 - w) * sn, 0.5 * sn) END, 1.0), 6) AS zn, round((e - (w * mean_e + (1 - w) * ge)) / greatest(CASE WHEN obs < 3 THEN se ELSE greatest(w * std_e + (1 - w) * se, 0.5 * se) END, 1.0), 6) AS ze FROM g WHERE g >= 100 AND n >= 5 AND e >= 20)"""
_E_TRIGGER = "CASE WHEN obs < 24 OR n < 10 OR e < 50 THEN 'none' WHEN z > 3 AND state >= 2 THEN 'both' WHEN z > 3 THEN 'zscore' WHEN state >= 2 THEN 'kleinberg' ELSE 'none' END"


def _engagement_days(s, d):
    t = table(s, d, "tweets").where("cluster_id >= 0")
    return D.engagement_series(t, "cluster_id", "created_at", "day", F.col("retweet_count_at_collection") + F.col("likes_at_collection"))


def _short(df):
    """Figures to four places: the running statistics of engagement are sums over the whole table in different orders."""
    return df.select("entity", "t", "n", "e", "path", *[F.round(c, 4).alias(c) for c in ("z_count", "z_engagement", "z")], F.col("state").cast("int").alias("state"), "trigger")


@PLANS(f"""WITH RECURSIVE {_E_SERIES}, {_E_STATS}, {_E_Z}, {_E_COLD}, {_states('obs >= 24')}, x AS (SELECT z.entity, z.t, z.n, z.e, z.obs, CASE WHEN obs < 24 THEN c.zn ELSE round(z.zn, 6) END AS zc, CASE WHEN obs < 24 THEN c.ze ELSE round(z.ze, 6) END AS zg, CASE WHEN obs < 24 THEN round(0.4 * c.zn + 0.6 * c.ze, 6) ELSE round(0.4 * z.zn + 0.6 * z.ze, 6) END AS z, CASE WHEN obs >= 24 THEN k.state WHEN c.zn IS NOT NULL THEN 0 END AS state FROM z LEFT JOIN c USING (entity, t) LEFT JOIN k ON k.entity = z.entity AND k.t = z.t)
SELECT entity, t, n, e, CASE WHEN obs < 24 THEN 'sparse' ELSE 'mature' END AS path, round(zc, 4) AS z_count, round(zg, 4) AS z_engagement, round(z, 4) AS z, state, CASE WHEN obs < 24 AND z > 3 THEN 'bayesian_cold_start' ELSE {_E_TRIGGER} END AS trigger FROM x""")
def sm10_detections(s, d):
    """SM10, SM12, WN05-WN08, WN10: counts and engagement scored, mixed, gated by activity; sparse clusters by shrinkage."""
    return _short(D.detections(_engagement_days(s, d)))


def _classical(rows: str, scored: str) -> str:
    return f"""WITH RECURSIVE {_E_SERIES}, {_E_STATS}, {_E_Z}, {_states(rows)}, x AS (SELECT z.entity, z.t, z.n, z.e, z.obs, CASE WHEN {scored} THEN round(z.zn, 6) END AS zc, CASE WHEN {scored} THEN round(z.ze, 6) END AS zg, CASE WHEN {scored} THEN round(0.4 * z.zn + 0.6 * z.ze, 6) END AS z, k.state FROM z LEFT JOIN k ON k.entity = z.entity AND k.t = z.t)
SELECT entity, t, n, e, CASE WHEN obs < 24 THEN 'sparse' ELSE 'mature' END AS path, zc AS z_count, zg AS z_engagement, z, state, {_E_TRIGGER} AS trigger FROM x"""


@PLANS(_classical("true", "true"))
def sm10_scores_for_all(s, d):
    """SM10 without shrinkage: every row is scored, sparse ones with relaxed deviations."""
    return D.detections(_engagement_days(s, d), bayesian=False)


@PLANS(_classical("obs >= 24 AND n >= 10 AND e >= 50", "z.obs >= 24 AND z.n >= 10 AND z.e >= 50"))
def sm11_legacy(s, d):
    """SM11: only mature rows with enough activity are scored, and only they move the automaton."""
    return D.detections(_engagement_days(s, d), compute_all=False, bayesian=False)


@PLANS()
def sm10_ensemble(s, d):
    """SM12, SM15: counts alone, routed, with scores carried forward; its parts have SQL."""
    return D.ensemble(_cluster_days(s, d))


@PLANS("""WITH b AS (SELECT min(ts) AS t0 FROM events), w AS (SELECT event_type, event_id, CAST(floor(date_diff('second', date_trunc('day', t0), ts) / 21600.0) AS BIGINT) AS k FROM events, b)
SELECT k, event_type, count(*) AS n FROM w GROUP BY k, event_type""")
def sm01_replay_windows(s, d):
    """SM01, DT05: tumbling windows from the data's first day, empty ones skipped."""
    e = table(s, d, "events")
    start = e.agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz").alias("t0"))
    k = F.floor(T.seconds_between(F.col("t0"), F.col("ts")) / 21600)
    return e.join(F.broadcast(start)).groupBy(k.alias("k"), "event_type").agg(F.count("*").alias("n"))


@PLANS("SELECT date_trunc('hour', ts)::TIMESTAMP AS w, count(*) AS n FROM events GROUP BY 1")
def sm02_window_counts(s, d):
    return table(s, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("w")).agg(F.count("*").alias("n"))


@PLANS("SELECT 'before' AS side, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' UNION ALL SELECT 'after', count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-22'")
def sm03_lookback_horizon(s, d):
    """SM03, SM04: history strictly before a time and the horizon from it."""
    e, at = table(s, d, "events"), F.lit("2024-01-15").cast("timestamp_ntz")
    week = T.interval("7d")
    before = e.where((F.col("ts") < at) & (F.col("ts") >= at - week)).agg(F.lit("before").alias("side"), F.count("*").alias("n"))
    return before.unionByName(e.where((F.col("ts") >= at) & (F.col("ts") < at + week)).agg(F.lit("after").alias("side"), F.count("*").alias("n")))


@PLANS("SELECT strftime(min(dd), '%Y-%m-%d') AS first_day, strftime(max(dd), '%Y-%m-%d') AS last_day, count(*) AS days, min(n) AS low, max(n) AS high, round(avg(n), 6) AS mean FROM (SELECT CAST(ts AS DATE) AS dd, count(*) AS n FROM events GROUP BY 1)")
def sm05_range_stats(s, d):
    day = table(s, d, "events").groupBy(F.to_date("ts").alias("dd")).agg(F.count("*").alias("n"))
    return day.agg(F.min("dd").cast("string").alias("first_day"), F.max("dd").cast("string").alias("last_day"), F.count("*").alias("days"), F.min("n").alias("low"), F.max("n").alias("high"), F.round(F.avg("n"), 6).alias("mean"))


@PLANS("SELECT CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-20' OR ts >= TIMESTAMP '2024-01-22' GROUP BY 1")
def st08_time_split(s, d):
    return time_split(table(s, d, "events"), "ts", "2024-01-20", "2024-01-22").groupBy("part").agg(F.count("*").alias("n"))


_SESSIONS = """e AS (SELECT user_id, ts, floor(value) AS v, CASE WHEN lag(ts) OVER w IS NULL THEN 0 WHEN ts > lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, floor(value))),
se AS (SELECT *, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, v ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM e)"""


@PLANS(f"WITH {_SESSIONS} SELECT user_id, session, min(ts) AS start, max(ts) AS \"end\", CAST(max(v) AS BIGINT) AS max_score, CAST(first(v ORDER BY ts, v) AS BIGINT) AS first_score, count(*) AS n FROM se GROUP BY user_id, session")
def sm06_sessions(s, d):
    """SM06, SM07, WN11, WN12: gap sessions and their aggregates."""
    e = table(s, d, "events").select("user_id", "ts", F.floor("value").cast("bigint").alias("v"))
    return S.events(e, "user_id", "ts", "v")


@PLANS(f"""WITH {_SESSIONS}, x AS (SELECT user_id, session, min(ts) AS start FROM se GROUP BY 1, 2)
SELECT x.user_id, x.session, x.start, count(f.ts) FILTER (f.ts < x.start + INTERVAL 6 HOUR) AS peek_n, CAST(coalesce(sum(floor(f.value)) FILTER (f.ts < x.start + INTERVAL 6 HOUR), 0) AS BIGINT) AS peek_v,
count(f.ts) FILTER (f.ts >= x.start + INTERVAL 6 HOUR) AS later_n, CAST(coalesce(sum(floor(f.value)) FILTER (f.ts >= x.start + INTERVAL 6 HOUR), 0) AS BIGINT) AS later_v
FROM x LEFT JOIN events f ON f.user_id = x.user_id AND f.ts >= x.start AND f.ts < x.start + INTERVAL 174 HOUR GROUP BY 1, 2, 3""")
def jn09_peek_and_horizon(s, d):
    e = table(s, d, "events").select("user_id", "ts", F.floor("value").cast("bigint").alias("v"))
    return S.peek_and_horizon(S.events(e, "user_id", "ts", "v"), e, "user_id", "ts", "v")


@PLANS("SELECT cluster_id, date_trunc('week', created_at)::TIMESTAMP AS t, count(*) AS n FROM tweets WHERE cluster_id >= 0 GROUP BY 1, 2")
def sm18_topic_series(s, d):
    return D.series(table(s, d, "tweets").where("cluster_id >= 0"), "cluster_id", "created_at", "week").select(F.col("entity").alias("cluster_id"), "t", "n")


@PLANS(f"WITH {_HOUR} SELECT entity, date_trunc('week', t)::TIMESTAMP AS t, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY 1, 2")
def sm19_resample(s, d):
    return D.resample(D.resample(_hourly(s, d), "day"), "week")


@PLANS("SELECT strftime(dd, '%Y-%m-%d') AS day, click, view, purchase, click + view + purchase AS total FROM (SELECT CAST(ts AS DATE) AS dd, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1)")
def st05_pivot(s, d):
    """ST05, ST07: long to wide with named columns (no extra pass to find them), and a sum across."""
    from tideline.operators.aggregates import sum_across

    names = ["click", "view", "purchase"]
    w = table(s, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).pivot("event_type", names).agg(F.count(F.lit(1))).na.fill(0, names)
    return w.withColumn("total", sum_across(names))


@PLANS("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS name, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2")
def st06_melt(s, d):
    names = ["click", "view", "purchase"]
    w = table(s, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).pivot("event_type", names).agg(F.count(F.lit(1)))
    return w.unpivot(["day"], names, "name", "n").where("n is not null")


@PLANS("SELECT event_type FROM (SELECT DISTINCT event_type FROM events WHERE ts < TIMESTAMP '2024-01-10' INTERSECT SELECT DISTINCT event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10')")
def st04_set_operations(s, d):
    e, at = table(s, d, "events"), F.lit("2024-01-10").cast("timestamp_ntz")
    return e.where(F.col("ts") < at).select("event_type").intersect(e.where(F.col("ts") >= at).select("event_type"))


@PLANS("WITH w AS (SELECT cluster_id, date_trunc('week', created_at)::TIMESTAMP AS t, count(*) AS n FROM tweets WHERE cluster_id >= 0 GROUP BY 1, 2) SELECT cluster_id, n FROM w WHERE t = (SELECT max(t) FROM w) ORDER BY n DESC, cluster_id LIMIT 10")
def sr08_top_by_latest(s, d):
    w = sm18_topic_series(s, d)
    last = w.agg(F.max("t").alias("t"))
    return w.join(F.broadcast(last), "t").orderBy(F.desc("n"), "cluster_id").limit(10).select("cluster_id", "n")
