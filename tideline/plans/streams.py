"""Structured Streaming runs over the whole events table, against the batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tideline.operators.staging import discarded_at_exit, shared_folder
from tideline.plans._register import Plans
from tideline.sources.tables import table
from tideline.streaming import replay as R

PLANS = Plans()


def _place(s) -> str:
    place = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    discarded_at_exit(s, place)
    return place


def _stream(s, d, place):
    """The events as files that arrive in two triggers: all of them, then the row that closes the open windows."""
    e = table(s, d, "events").select("event_id", "event_type", "user_id", "ts")
    R.arriving(e, f"{place}/in")
    files = len(s.read.parquet(f"{place}/in").inputFiles())
    R.closing(e, f"{place}/in", "ts")
    return R.file_stream(s, f"{place}/in", e.schema, files)


@PLANS("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def sm01_stream_windows(s, d):
    """SM01, SM20: tumbling windows on a stream with a watermark and a checkpoint."""
    place = _place(s)
    out = R.drained(R.windowed_counts(_stream(s, d, place), "event_type", "ts", "1 hour"), "windows", place)
    return out.where("event_type is not null").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@PLANS("WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), x AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM x GROUP BY user_id, k")
def sm06_stream_sessions(s, d):
    place = _place(s)
    out = R.drained(R.gap_sessions(_stream(s, d, place), "user_id", "ts", "6 hours"), "sessions", place)
    return out.where("user_id is not null").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@PLANS("WITH b AS (SELECT event_type AS key, date_trunc('day', ts)::TIMESTAMP AS t, count(*) AS n FROM events GROUP BY 1, 2), z AS (SELECT *, avg(n) OVER f AS m, stddev_pop(n) OVER f AS s, count(n) OVER f AS k FROM b WINDOW f AS (PARTITION BY key ORDER BY t ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) SELECT key, t, n, round((n - m) / nullif(s, 0), 6) AS z FROM z WHERE k = 7")
def sm10_stream_scores(s, d):
    """WN01 on keyed state: daily counts are streamed and scored against the last seven."""
    from tideline.operators.detect import series

    place = _place(s)
    daily = series(table(s, d, "events"), "event_type", "ts", "day")
    daily.write.parquet(f"{place}/daily")
    stream = R.file_stream(s, f"{place}/daily", daily.schema, 1000)
    out = R.drained(R.running_scores(stream, "entity", "t", "n", 7), "scores", place)
    return out.select("key", F.col("t").cast("timestamp_ntz").alias("t"), "n", "z")
