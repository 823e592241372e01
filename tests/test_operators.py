"""Golden values and brute force for operators that SQL can't express, and edge cases of the rest."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.functions import maths as M
from tideline.functions import text as X
from tideline.functions import time as T
from tideline.operators import aggregates as A
from tideline.operators import clusters as C
from tideline.operators import dedup, detect, evaluate, parsing, ranking, retrieval, sessions
from tideline.sources import readers, writers


def one(df):
    return df.collect()[0]


def test_gini_and_entropy(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 1), ("a", 1), ("b", 0), ("b", 0), ("b", 0), ("b", 10), ("c", 0), ("d", None)], "g string, v int")
    assert {r.g: r.gini for r in A.gini(df, "g", "v").collect()} == {"a": 0.0, "b": 0.75, "c": 0.0}
    e = spark.createDataFrame([("x", "A"), ("x", "B"), ("y", "A"), ("y", "A"), ("z", None)], "g string, c string")
    assert {r.g: r.entropy for r in A.entropy(e, "g", "c").collect()} == {"x": 1.0, "y": 0.0}


def test_one_vote(spark):
    df = spark.createDataFrame([("g", "u1", 1.0)] * 4 + [("g", "u2", -1.0)], "g string, u string, v double")
    r = one(A.one_vote(df, "g", "u", "v"))
    assert (r.naive_mean, r.vote_mean, r.vote_std, r.per_user) == (0.6, 0.0, 1.0, 2.5)


def test_rolling_z_gates(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("e", start + dt.timedelta(hours=i), 10 if i % 2 else 14) for i in range(24)] + [("e", start + dt.timedelta(hours=24), 30)]
    df = spark.createDataFrame(rows, "entity string, t timestamp_ntz, n long")
    r = one(detect.rolling_z(df, 24))
    assert (r.z, r.mean, r["std"]) == (9.0, 12.0, 2.0)
    assert detect.rolling_z(df.withColumn("n", F.when(F.col("n") == 30, 9).otherwise(F.col("n"))), 24).count() == 0
    assert detect.rolling_z(df.withColumn("n", F.lit(12)), 24).count() == 0


def test_sessions_split_only_past_the_gap(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t, 1), ("a", t + dt.timedelta(hours=6), 2), ("b", t, 1), ("b", t + dt.timedelta(hours=6, seconds=1), 2)], "k string, at timestamp_ntz, v int")
    assert {r.k: r.n for r in sessions.events(df, "k", "at", "v").groupBy("k").agg(F.count("*").alias("n")).collect()} == {"a": 1, "b": 2}


def test_bursts_equal_a_loop(spark):
    random.seed(4)
    start = dt.datetime(2024, 1, 1)
    values = [random.choice([3, 5, 8, 20, 60]) for _ in range(80)]
    df = spark.createDataFrame([("e", start + dt.timedelta(hours=i), v) for i, v in enumerate(values)], "entity string, t timestamp_ntz, n long")
    got = [r.state for r in detect.burst_states(detect.active_stats(df)).orderBy("t").collect()]
    pairs = [(values[i], max(1.0, float(np.mean(values[max(0, i - 168) : i])))) for i in range(24, 80)]
    assert got == detect.burst_by_brute_force(pairs)
    assert set(got) > {0}


def test_ensemble_on_an_empty_table(spark):
    df = spark.createDataFrame([], "entity string, t timestamp_ntz, n long")
    assert detect.ensemble(df).count() == 0


def test_online_clustering():
    v = np.array([[1, 0], [0.8, 0.6], [0, 1]], float)
    ids, sims = C.leader_cluster(v, 0.75)
    assert ids == [0, 0, 1] and np.allclose(sims, [1, 0.8, 1])
    ids, sims = C.leader_cluster(np.array([[1, 0], [0, 1]], float), 0.75, cap=1)
    assert ids == [0, 0] and sims == [1.0, 1.0]
    ids, _ = C.leader_cluster(np.array([[1, 0], [0.85, math.sqrt(1 - 0.85**2)]], float), 0.85, update=False)
    assert ids == [0, 0]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.floats(-1, 1), min_size=3, max_size=3).filter(lambda v: sum(x * x for x in v) > 0.01), min_size=1, max_size=30))
def test_online_clustering_invariants(vectors):
    ids, sims = C.leader_cluster(np.array(vectors), 0.8)
    assert ids[0] == 0 and max(ids) + 1 == len(set(ids))
    assert all(s >= 0.8 or i not in ids[:k] for k, (i, s) in enumerate(zip(ids, sims)))


def test_gates(spark):
    df = spark.createDataFrame([(1, ""), (2, "@user"), (3, "one two three"), (4, "lol that is so funny"), (5, "Did you know this fact?"), (6, None)], "i int, t string")
    got = {r.i: r.r for r in df.select("i", X.stream_gate(F.col("t")).alias("r")).collect()}
    assert got == {1: "empty", 2: "empty_after_clean", 3: "too_short_3_words", 4: "reaction", 5: "", 6: "empty"}
    df = spark.createDataFrame([(1, "wow"), (2, "twenty characters in words"), (3, "What is happening here today?"), (4, None)], "i int, t string")
    got = {r.i: r.r for r in df.select("i", X.batch_gate(F.col("t")).alias("r")).collect()}
    assert got == {1: "too_short_chars", 2: "too_few_words", 3: "is_question", 4: "null_or_invalid"}


def test_text_builders(spark):
    df = spark.createDataFrame([("Sooooo   good!!! &amp; #WowThis @çava http://x.y/z",)], "t string")
    assert one(df.select(X.tweet_clean(F.col("t")).alias("c"))).c == "Soo good! & WowThis @USER"
    assert one(df.select(X.segment_hashtags(F.col("t")).alias("c"))).c.count("Wow This") == 1
    c = spark.createDataFrame([('"The claim is: taxes rose..."',)], "t string")
    assert one(c.select(X.postprocess_claim(F.col("t")).alias("c"))).c == "taxes rose."
    e = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b"])], "a array<string>, b array<string>")
    assert [r.j for r in e.select(X.jaccard(F.col("a"), F.col("b"), 0.5).alias("j")).collect()] == [0.5, 0.0, 0.5]


def test_time_builders(spark):
    df = spark.createDataFrame([("2020-01-01 20:00:00 EST",), ("2020-01-01 20:00:00 EDT",), ("junk",)], "t string")
    assert [r.u for r in df.select(T.eastern_to_utc(F.col("t")).alias("u")).collect()] == [dt.datetime(2020, 1, 2, 1), dt.datetime(2020, 1, 2), None]
    friday = spark.createDataFrame([(dt.datetime(2024, 1, 5),)], "t timestamp_ntz").select(*[v.alias(k) for k, v in T.day_parts(F.col("t")).items()])
    assert one(friday).is_weekend_compat and not one(friday).is_weekend
    assert T.window_size("6h") == (6, "HOUR")
    with pytest.raises(ValueError):
        T.window_size("6x")


def test_scores(spark):
    df = spark.createDataFrame([(101, 10001, 5.1, 0, 0, 8, 10)], "v int, f int, z double, a int, b int, h int, n int")
    assert one(df.select(F.round(M.virality_score(F.col("v"), F.col("f"), F.col("z")), 6).alias("s"))).s == 0.85
    low, high = M.wilson(F.col("h"), F.col("n"))
    r = one(df.select(F.round(low, 4).alias("low"), F.round(high, 4).alias("high")))
    assert (r.low, r.high) == (0.4902, 0.9433)
    low, high = M.wilson(F.col("a"), F.col("b"))
    assert tuple(one(df.select(low, high))) == (0.0, 0.0)


def test_statistics(spark):
    assert [evaluate.bins_for(n) for n in (20, 100, 4)] == [4, 10, 3]
    assert abs(evaluate.chi2_p(3.841459) - 0.05) < 1e-6
    assert abs(evaluate.normal_quantile(0.975) - 1.959964) < 1e-5
    rows = [(True, False)] * 2 + [(False, True)] * 10 + [(True, True)] * 5
    assert one(evaluate.mcnemar(spark.createDataFrame(rows, "a boolean, b boolean"), "a", "b")).chi2 == 4.083333
    c = one(evaluate.confusion(spark.createDataFrame([(True, True), (True, True), (False, True), (False, True)], "y boolean, p boolean"), "y", "p"))
    assert (c.precision, c.recall, c.f2) == (0.5, 1.0, 0.833333)
    empty = one(evaluate.confusion(spark.createDataFrame([], "y boolean, p boolean"), "y", "p"))
    assert (empty.precision, empty.f1) == (0.0, 0.0)


def test_row_index_and_ranks(spark):
    random.seed(1)
    values = [random.randrange(50) for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v int").repartition(7)
    got = sorted((r.v, r.k, r.i) for r in ranking.row_index(df, ["v", "k"], "i").collect())
    assert [x[2] for x in got] == list(range(300))
    r = {x.k: x.pct_rank for x in ranking.average_rank_by_counts(df, "v").collect()}
    for k, v in enumerate(values):
        assert abs(r[k] - (sum(x < v for x in values) + (values.count(v) + 1) / 2) / 300) < 1e-12


def test_jaccard_links_lose_nothing(spark):
    random.seed(2)
    rows = []
    for i in range(60):
        base = random.sample(range(40), 12)
        rows += [(i * 3, base), (i * 3 + 1, base[:11] + [99]), (i * 3 + 2, base)]
    df = spark.createDataFrame([(k, [str(x) for x in v]) for k, v in rows], "k int, w array<string>")
    got = {(r.key_a, r.key_b) for r in dedup.jaccard_links(df, "k", "w", 0.8).collect()}
    sets = {k: set(v) for k, v in rows}
    truth = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert got == truth


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(80, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(5)
    got = {}
    for r in retrieval.knn(df.where("id % 10 = 0"), df, "id", "v", 4, same=True).collect():
        got.setdefault(r["query"], []).append((r.place, r["key"]))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q, hits in got.items():
        s = np.round(u @ u[q], 6)
        s[q] = -9
        assert [k for _, k in sorted(hits)] == np.lexsort((np.arange(80), -s))[:4].tolist()


def test_response_parsing(spark):
    rows = [('{"reasoning": "ok", "confidence": 5}',), ('reasoning": "ok", "confidence": 5}',), ('noise {"reasoning": "ok"} noise',), ('"reasoning": "cut', ), ("nothing",), (None,)]
    got = parsing.parse_response(spark.createDataFrame(rows, "response_json string")).collect()
    assert [(r.reasoning, r.parse_failed) for r in got] == [("ok", False), ("ok", False), ("ok", False), ("cut", False), (None, True), (None, True)]


def test_readers_and_writers(spark, tmp_path):
    df = spark.createDataFrame([("1", "a,b", 2.5), ("2", 'say "x"', None)], "id string, t string, v double")
    writers.csv(df, f"{tmp_path}/c")
    assert sorted(map(tuple, readers.delimited(spark, f"{tmp_path}/c", "id string, t string, v double").collect())) == sorted(map(tuple, df.collect()))
    writers.json(df, f"{tmp_path}/j")
    (tmp_path / "j" / "part-x.json").write_text('{"id": "3", "t": "ok"}\n{"id": broken\n')
    good, bad = readers.json_lines(spark, f"{tmp_path}/j", "id string, t string, v double")
    assert good.count() == 3 and bad.count() == 1
    e = readers.ensure_columns(df, "id long, extra string")
    assert e.schema.simpleString() == "struct<id:bigint,extra:string>"
    assert readers.config_from(readers.PipelineConfig, {"min_words": 7, "unknown": 1}).min_words == 7
    np.save(tmp_path / "m.npy", np.eye(3, dtype="float32"))
    assert readers.vectors_from_npy(spark, str(tmp_path / "m.npy")).count() == 3
    t = df.withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    writers.star_schema({"tweets": t, "users": df}, f"{tmp_path}/star")
    assert spark.read.parquet(f"{tmp_path}/star/tweets").where("date = '2024-01-01'").count() == 2
    nested = spark.read.schema(readers.NESTED_TWEET).json(spark.sparkContext.parallelize(['{"id_str": "1", "created_at": "Wed Oct 10 20:19:24 +0000 2018", "text": "short", "extended_tweet": {"full_text": "longer"}, "entities": {"hashtags": [{"text": "a"}, {"text": "b"}]}}']))
    r = one(readers.flat_tweets(nested))
    assert (r.text, r.hashtags, r.created_at) == ("longer", "a|b", dt.datetime(2018, 10, 10, 20, 19, 24))


def test_mini_batch_leaders_keep_every_cluster(spark):
    import numpy as np

    from tideline.operators.clusters import mini_batch_leaders

    rows = [(2 * i + j, np.eye(40)[i].tolist()) for i in range(40) for j in range(2)] + [(90, [0.0] * 40), (91, [0.0] * 40)]
    df = spark.createDataFrame(rows, "id int, v array<double>").repartition(3)
    got = {r.id: r for r in mini_batch_leaders(df, "id", "v", 0.75, most=10).collect()}
    assert len(got) == 82 and all(r.similarity >= 0.75 for r in got.values())
    assert len({r.cluster for r in got.values()}) == 41 and all(got[2 * i].cluster == got[2 * i + 1].cluster for i in range(40))
    assert mini_batch_leaders(df.where("false"), "id", "v").count() == 0


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Stopped after the first files and started again, a stream puts out what one run over all files does, each session once."""
    from tideline.streaming import replay as R

    start = dt.datetime(2024, 1, 1)
    rows = [(i % 3, start + dt.timedelta(minutes=i * 100)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz")
    place = str(tmp_path)
    sessions = lambda: R.gap_sessions(R.file_stream(spark, f"{place}/in", df.schema, 1), "k", "ts", "6 hours", "1 hour")
    R.arriving(df.where("ts < '2024-01-05'").coalesce(1), f"{place}/in")
    first = R.drained(sessions(), "s", place).where("k is not null").count()
    R.arriving(df.where("ts >= '2024-01-05'").coalesce(1), f"{place}/in")
    R.closing(df, f"{place}/in", "ts")
    got = sorted((r.k, r.start.replace(tzinfo=None), r.n) for r in R.drained(sessions(), "s", place).where("k is not null").collect())
    want = sorted((r.k, r.start, r.n) for r in R.gap_sessions(df, "k", "ts").select("k", F.col("start").cast("timestamp_ntz").alias("start"), "n").collect())
    assert got == want and first < len(got)
