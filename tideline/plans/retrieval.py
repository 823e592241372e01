"""Vectors and words: norms, centroids, neighbours, BM25, hybrid matches, keywords, medoids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import maths as M
from tideline.functions import text as X
from tideline.operators import retrieval as R
from tideline.plans._register import Plans
from tideline.sources.tables import table

PLANS = Plans()
_DOT = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[])"
_COS = "round(" + _DOT + " / greatest(sqrt(" + _DOT.format("{0}", "{0}") + ") * sqrt(" + _DOT.format("{1}", "{1}") + "), 1e-10), 6)"


@PLANS("SELECT label, count(*) AS n, round(avg(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 5) AS mean_norm, round(max(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 5) AS max_norm FROM embeddings GROUP BY label")
def ve04_norms(s, d):
    """VE01, VE04."""
    n = M.norm(F.col("embedding"))
    return table(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(n), 5).alias("mean_norm"), F.round(F.max(n), 5).alias("max_norm"))


_CENTRES = """u AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1)"""


@PLANS(f"WITH {_CENTRES} SELECT label, i, round(x / greatest(n, 1e-10), 5) AS x FROM m JOIN n USING (label)")
def ve02_centroids(s, d):
    c = R.centroids(table(s, d, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("p", "x")).select("label", (F.col("p") + 1).cast("bigint").alias("i"), F.round("x", 5).alias("x"))


@PLANS(f"""WITH {_CENTRES}, c AS (SELECT label, list(x / greatest(n, 1e-10) ORDER BY i) AS c FROM m JOIN n USING (label) GROUP BY label),
p AS (SELECT vec_id, c.label AS nearest, list_distance(embedding::DOUBLE[], c.c) AS dist FROM embeddings, c) SELECT vec_id, arg_min(nearest, dist) AS nearest, round(min(dist), 5) AS distance FROM p GROUP BY vec_id""")
def ve03_nearest_centroid(s, d):
    e = table(s, d, "embeddings")
    return R.nearest_centroid(e, "vec_id", "embedding", R.centroids(e, "label", "embedding"), "label")


@PLANS("WITH p AS (SELECT a.vec_id AS query, b.vec_id AS key, " + _COS.format("a.embedding", "b.embedding") + " AS cosine FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id != b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, key) AS place FROM p) SELECT query, key, place FROM r WHERE place <= 5")
def jn15_knn(s, d):
    """JN15, JN13, SR05: the stated query set (ids divisible by 50) against all rows."""
    e = table(s, d, "embeddings")
    return R.knn(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 5, same=True).select("query", "key", F.col("place").cast("bigint").alias("place"))


@PLANS("WITH p AS (SELECT a.vec_id AS query, b.vec_id AS key, a.label = b.label AS same, " + _COS.format("a.embedding", "b.embedding") + " AS cosine FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id != b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY same DESC, cosine DESC, key) AS place FROM p) SELECT query, key, same, place FROM r WHERE place <= 5")
def ud19_in_cluster_first(s, d):
    """UD19: neighbours of the own cluster first, filled up from all; 5 of each are enough for the merge."""
    from pyspark.sql import Window

    e = table(s, d, "embeddings")
    q, labels = e.where("vec_id % 50 = 0"), e.select("vec_id", "label")
    every = R.knn(q, e, "vec_id", "embedding", 5, same=True)
    inside = R.knn(q, e, "vec_id", "embedding", 5, same=True, within="label")
    both = every.unionByName(inside).select("query", "key", "cosine").distinct()
    both = both.join(labels.withColumnsRenamed({"vec_id": "query", "label": "lq"}), "query").join(labels.withColumnsRenamed({"vec_id": "key", "label": "lk"}), "key").withColumn("same", F.col("lq") == F.col("lk"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("same"), F.desc("cosine"), "key"))
    return both.withColumn("place", place.cast("bigint")).where("place <= 5").select("query", "key", "same", "place")


_BM25 = """t AS (SELECT item_id, string_split_regex(lower(text), '[^a-z0-9]+') AS w FROM heldout_items), p AS (SELECT item_id, w FROM (SELECT item_id, unnest(w) AS w FROM t) WHERE w != ''), tf AS (SELECT item_id, w, count(*) AS tf FROM p GROUP BY 1, 2), ln AS (SELECT item_id, count(*) AS len FROM p GROUP BY 1),
st AS (SELECT (SELECT count(*) FROM t)::DOUBLE AS n, (SELECT avg(len) FROM ln) AS av), dfs AS (SELECT w, count(*) AS df FROM tf GROUP BY 1), q AS (SELECT DISTINCT sentence_id AS query, w FROM (SELECT sentence_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM (SELECT sentence_id, min(text) AS text FROM normalizations GROUP BY 1)) WHERE w != ''),
sc AS (SELECT query, item_id AS key, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / av))), 6) AS score FROM q JOIN dfs USING (w) JOIN tf USING (w) JOIN ln USING (item_id), st GROUP BY 1, 2)"""


def _bm25(s, d, k):
    items = table(s, d, "heldout_items").select("item_id", F.split(F.lower("text"), "[^a-z0-9]+").alias("w"))
    q = table(s, d, "normalizations").groupBy("sentence_id").agg(F.min("text").alias("text")).select("sentence_id", F.split(F.lower("text"), "[^a-z0-9]+").alias("qw"))
    return R.bm25(items, q, "item_id", "w", "sentence_id", "qw", k)


@PLANS(f"WITH {_BM25} SELECT query, round(max(score), 4) AS best, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS place FROM sc) WHERE place <= 5 GROUP BY query")
def ud16_bm25(s, d):
    return _bm25(s, d, 5).groupBy("query").agg(F.round(F.max("score"), 4).alias("best"), F.count("*").alias("n"))


@PLANS()
def ud17_hybrid(s, d):
    """UD17, UD18, UD20: hashed word vectors, BM25 and entities combined; the vectors are a stand-in for a hosted embedder."""
    from pyspark.ml.feature import HashingTF

    items = table(s, d, "heldout_items").select(F.col("item_id").cast("string").alias("id"), "text")
    q = table(s, d, "normalizations").groupBy("sentence_id").agg(F.min("text").alias("text")).select(F.col("sentence_id").alias("id"), "text")
    from pyspark.ml.functions import vector_to_array

    tf = HashingTF(numFeatures=64, inputCol="w", outputCol="v")
    vec = lambda df: tf.transform(df.withColumn("w", X.tokens(F.col("text")))).select("id", "text", vector_to_array("v").alias("v"))
    hits = R.knn(vec(q), vec(items), "id", "v", 20)
    words = _bm25(s, d, 20).withColumn("key", F.col("key").cast("string"))
    pairs = hits.select("query", "key").unionByName(words.select("query", "key")).distinct()
    ent = pairs.join(q.select(F.col("id").alias("query"), X.entities(F.col("text")).alias("eq")), "query").join(items.select(F.col("id").alias("key"), X.entities(F.col("text")).alias("ek")), "key").select("query", "key", X.jaccard(F.col("eq"), F.col("ek"), 0.5).alias("overlap"))
    return R.hybrid(hits, words, ent)


@PLANS("""WITH w AS (SELECT split, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM normalizations), tf AS (SELECT split, w, count(*) AS tf FROM w WHERE length(w) > 2 AND w NOT IN ('the', 'and', 'for', 'that') GROUP BY 1, 2), dfs AS (SELECT w, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(DISTINCT split) AS t FROM tf),
sc AS (SELECT split, w, round(tf * ln((t + 1.0) / (df + 1)), 6) AS score FROM tf JOIN dfs USING (w), n), r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY score DESC, w) AS place FROM sc) SELECT split, w, score, place FROM r WHERE place <= 12""")
def ud15_keywords(s, d):
    """UD15, SF23."""
    return R.keywords(table(s, d, "normalizations"), "split", F.split(F.lower("text"), "[^a-z]+"), 12, ["the", "and", "for", "that"])


@PLANS("WITH c AS (SELECT DISTINCT sentence_id, model_name, list_distinct(string_split(lower(normalized_claim), ' ')) AS w FROM normalizations WHERE normalized_claim IS NOT NULL), t AS (SELECT DISTINCT sentence_id, list_distinct(string_split(lower(text), ' ')) AS tw FROM normalizations), m AS (SELECT sentence_id, model_name, max(len(list_intersect(w, tw)) / len(w)::DOUBLE) AS prec, max(len(list_intersect(w, tw)) / len(tw)::DOUBLE) AS rec FROM c JOIN t USING (sentence_id) GROUP BY 1, 2) SELECT sentence_id, model_name, round(CASE WHEN prec + rec = 0 THEN 0 ELSE 10 * prec * rec / (rec + 9 * prec) END, 5) AS score FROM m")
def ud21_token_meteor(s, d):
    """UD21: exact-token METEOR (recall weighted nine to one, no stems or synonyms) of a claim against its text."""
    n = table(s, d, "normalizations")
    c = n.where("normalized_claim is not null").select("sentence_id", "model_name", F.array_distinct(F.split(F.lower("normalized_claim"), " ")).alias("w")).distinct()
    t = n.select("sentence_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("tw")).distinct()
    hit = F.size(F.array_intersect("w", "tw")).cast("double")
    m = c.join(t, "sentence_id").groupBy("sentence_id", "model_name").agg(F.max(hit / F.size("w")).alias("p"), F.max(hit / F.size("tw")).alias("r"))
    p, r = F.col("p"), F.col("r")
    return m.select("sentence_id", "model_name", F.round(F.when(p + r == 0, 0.0).otherwise(10 * p * r / F.nullif(r + 9 * p, F.lit(0.0))), 5).alias("score"))


@PLANS("WITH p AS (SELECT a.label, a.vec_id, avg(" + _COS.format("a.embedding", "b.embedding") + ") AS m FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id != b.vec_id GROUP BY 1, 2) SELECT label, round(max(round(m, 4)), 3) AS best FROM p GROUP BY label")
def ud21_medoids(s, d):
    """UD21, UD22: the row with the highest mean similarity to its group. The mean over a group's others is a product with the sum of its
    unit vectors, so no pair is made."""
    e = table(s, d, "embeddings").select("label", "vec_id", M.normalised(F.col("embedding")).alias("v"))
    total = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("t"))
    n = e.groupBy("label").agg(F.count("*").alias("n"))
    m = e.join(total, "label").join(n, "label").where("n > 1").select("label", "vec_id", ((M.dot(F.col("v"), F.col("t")) - 1) / (F.col("n") - 1)).alias("m"))
    return m.groupBy("label").agg(F.round(F.max(F.round("m", 4)), 3).alias("best"))
