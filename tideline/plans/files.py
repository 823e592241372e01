"""Sources and sinks in round trips, and the remaining selections: bands, hard examples, counters, neighbour counts."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions import maths as M
from tideline.operators import detect, retrieval
from tideline.operators.staging import discarded_at_exit, shared_folder
from tideline.plans._register import Plans
from tideline.sources import readers, writers
from tideline.sources.tables import table

PLANS = Plans()


def _place(s) -> str:
    path = f"{shared_folder(s)}/files-{uuid.uuid4().hex}"
    discarded_at_exit(s, path)
    return path


@PLANS("SELECT DISTINCT sentence_id, label, split, replace(replace(text, chr(10), ' '), chr(9), ' ') AS text FROM normalizations")
def src06_tsv_round_trip(s, d):
    """SRC04-SRC06, SNK03: delimited text with a schema; quotes and separators survive."""
    n = table(s, d, "normalizations").select("sentence_id", "label", "split", F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" ")).alias("text")).distinct()
    path = _place(s)
    writers.csv(n, path, sep="\t")
    return readers.delimited(s, path, n.schema, sep="\t")


@PLANS("SELECT tweet_id, text, likes FROM (SELECT tweet_id, min(text) AS text, max(likes_at_collection) AS likes FROM tweets GROUP BY 1)")
def src07_nested_json(s, d):
    """SRC07, JS02, SNK04: nested JSON lines, broken ones apart, flattened with the longest text there is."""
    t = table(s, d, "tweets").groupBy("tweet_id").agg(F.min("text").alias("text"), F.max("likes_at_collection").alias("likes"))
    path = _place(s)
    nested = t.select(F.col("tweet_id").alias("id_str"), F.substring("text", 1, 20).alias("text"), F.col("likes").alias("favorite_count"), F.struct(F.col("text").alias("full_text")).alias("extended_tweet"))
    writers.json(nested, path)
    s.createDataFrame([('{"id_str": broken',)], "value string").write.mode("append").text(path)
    good, _ = readers.json_lines(s, path, readers.NESTED_TWEET)
    return readers.flat_tweets(good).select("tweet_id", "text", "likes")


@PLANS("SELECT model, count(*) AS n FROM predictions WHERE raw_response IS NOT NULL AND NOT regexp_matches(raw_response, '^(ERROR|TIMEOUT):?') GROUP BY 1")
def src08_results(s, d):
    ok = readers.result_bands(table(s, d, "predictions"), "raw_response", "confidence", 70, 30)
    return ok.groupBy("model").agg(F.count("*").alias("n"))


@PLANS("SELECT CASE WHEN confidence >= 70 THEN 'good' WHEN confidence <= 30 THEN 'bad' ELSE 'middle' END AS band, count(*) AS n FROM predictions WHERE raw_response IS NOT NULL AND NOT regexp_matches(raw_response, '^(ERROR|TIMEOUT):?') GROUP BY 1")
def ud20_bands(s, d):
    return readers.result_bands(table(s, d, "predictions"), "raw_response", "confidence", 70, 30).groupBy("band").agg(F.count("*").alias("n"))


@PLANS("SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM users")
def src13_largest_file(s, d):
    """SRC01-SRC03, SRC13, SNK01, SNK02: zstd files of bounded size; the file with most rows of a folder."""
    path = _place(s)
    u = table(s, d, "users")
    writers.parquet(u.coalesce(1), f"{path}", rows_a_file=None)
    writers.parquet(u.limit(3), path, mode="append")
    return readers.largest_file(s, path).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@PLANS("SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS n FROM (SELECT DISTINCT tweet_id, created_at FROM tweets) GROUP BY 1")
def snk05_partitioned(s, d):
    """SNK05: relations written by day and read back; the date column comes from the folders."""
    path = _place(s)
    t = table(s, d, "tweets").select("tweet_id", "created_at").distinct()
    writers.star_schema({"tweets": t.repartition("created_at")}, path)
    return s.read.parquet(f"{path}/tweets").groupBy(F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n"))


@PLANS("SELECT a.vec_id AS query, count(*) AS near FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id != b.vec_id AND round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / greatest(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 1e-10), 6) >= 0.25 GROUP BY 1")
def jn13_neighbour_counts(s, d):
    """JN13: how many rows lie within a cosine of each row of the stated query set."""
    e = table(s, d, "embeddings")
    return retrieval.near_counts(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 0.25)


@PLANS("WITH b AS (SELECT event_type AS entity, date_trunc('hour', ts)::TIMESTAMP AS t, count(*) AS n FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t) - 1 AS obs FROM b) SELECT entity, count(*) AS windows, count(*) FILTER (least(obs, 168) < 24) AS sparse, count(*) FILTER (least(obs, 168) >= 24) AS mature, CAST(sum(n) AS BIGINT) AS total FROM k GROUP BY 1")
def sm12_counters(s, d):
    """SM12: how many windows of each entity took which path."""
    st = detect.active_stats(detect.series(table(s, d, "events"), "event_type", "ts", "hour"))
    return st.groupBy("entity").agg(F.count("*").alias("windows"), F.count_if(F.col("obs") < detect.MATURE).alias("sparse"), F.count_if(F.col("obs") >= detect.MATURE).alias("mature"), F.sum("n").alias("total"))


@PLANS("""WITH u AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1), c AS (SELECT label, list(x / greatest(n, 1e-10) ORDER BY i) AS c FROM m JOIN n USING (label) GROUP BY label),
p AS (SELECT e.label, vec_id, round(list_dot_product(embedding::DOUBLE[], c.c) / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-10), 6) AS s FROM embeddings e JOIN c ON c.label = e.label) SELECT label, vec_id, k FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY s, vec_id) AS k FROM p) WHERE k <= 3""")
def ud22_hard_examples(s, d):
    """UD22: the rows least like the centre of their own group."""
    e = table(s, d, "embeddings")
    j = e.join(retrieval.centroids(e, "label", "embedding"), "label").select("label", "vec_id", F.round(M.cosine(F.col("embedding"), F.col("centroid")), 6).alias("c"))
    return j.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("c", "vec_id")).cast("bigint")).where("k <= 3").select("label", "vec_id", "k")


@PLANS("WITH a AS (SELECT sentence_id, lower(true_label) = 'yes' AS y, confidence / 100.0 AS c FROM predictions WHERE model = 'deb-base' AND confidence IS NOT NULL AND true_label IS NOT NULL), m AS (SELECT avg(c) FILTER (y) AS a, avg(c) FILTER (NOT y) AS b, var_samp(c) FILTER (y) AS va, var_samp(c) FILTER (NOT y) AS vb FROM a) SELECT round(a - b, 6) AS mean_shift, round(va / nullif(vb, 0), 5) AS variance_ratio FROM m")
def ev14_shifts(s, d):
    """EV14: mean and variance shift between two sides."""
    p = table(s, d, "predictions").where("model = 'deb-base' and confidence is not null and true_label is not null")
    y, c = F.lower("true_label") == "yes", F.col("confidence") / 100.0
    m = p.agg(F.avg(F.when(y, c)).alias("a"), F.avg(F.when(~y, c)).alias("b"), F.var_samp(F.when(y, c)).alias("va"), F.var_samp(F.when(~y, c)).alias("vb"))
    return m.select(F.round(F.col("a") - F.col("b"), 6).alias("mean_shift"), F.round(F.col("va") / F.nullif(F.col("vb"), F.lit(0.0)), 5).alias("variance_ratio"))
