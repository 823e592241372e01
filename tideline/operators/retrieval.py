"""Search over vectors and words: nearest neighbours in blocks, BM25, hybrid and two-stage matches, keywords, centroids."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import maths as M
from tideline.operators.staging import stage

#: Queries sent to the tasks at once: 20,000 vectors of 64 floats are 5 MB; larger query sets go in blocks.
QUERY_BLOCK = 20_000


def knn(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, same: bool = False, within: str | None = None) -> DataFrame:
    """The ``k`` nearest of ``base`` for every query by cosine: ``query``, ``key``, ``cosine``, ``place``; ties go to the smaller key.

    A stated query set against all rows: queries go to the tasks in blocks of ``QUERY_BLOCK``, every task keeps its own ``k`` best per
    query (matrix product of batches), and only those are shuffled and merged. ``same`` leaves out a query's own row; ``within`` names a column that must be equal on both sides."""
    own = [within] if within else []
    total = queries.count()
    kind = dict(base.dtypes)[key]
    blocks = max(1, -(-total // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        got = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).select(key, vector, *own).toPandas()
        if not len(got):
            continue
        ids, group = got[key].to_numpy(), got[within].to_numpy() if within else None
        q = np.stack(got[vector].to_numpy()).astype(np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-10)

        def scan(batches: Iterator[pd.DataFrame], ids: np.ndarray = ids, q: np.ndarray = q, group: np.ndarray | None = group) -> Iterator[pd.DataFrame]:
            best_s, best_k = np.full((len(q), 0), 0.0), np.zeros((len(q), 0), ids.dtype)
            for pdf in batches:
                if not len(pdf):
                    continue
                keys = pdf[key].to_numpy()
                x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
                s = np.round(q @ x.T, 6)
                if same:
                    s[ids[:, None] == keys[None, :]] = -9.0
                if within:
                    s[group[:, None] != pdf[within].to_numpy()[None, :]] = -9.0
                s, kk = np.hstack([best_s, s]), np.hstack([best_k, np.broadcast_to(keys, (len(q), len(keys)))])
                order = np.lexsort((kk, -s), axis=1)[:, :k]
                best_s, best_k = np.take_along_axis(s, order, 1), np.take_along_axis(kk, order, 1)
            n = best_s.shape[1]
            yield pd.DataFrame({"query": np.repeat(ids, n), "key": best_k.reshape(-1), "cosine": best_s.reshape(-1)}).query("cosine > -5")

        part = base.select(key, vector, *own).mapInPandas(scan, f"query {kind}, key {kind}, cosine double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = base.sparkSession.createDataFrame([], f"query {kind}, key {kind}, cosine double")
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "key")
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def near_counts(queries: DataFrame, base: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """``query``, ``near``: rows of ``base`` (but its own) at cosine ``least`` or more. Queries in blocks; tasks send one count a query."""
    total = queries.count()
    kind = dict(base.dtypes)[key]
    blocks = max(1, -(-total // QUERY_BLOCK))
    out = base.sparkSession.createDataFrame([], f"query {kind}, c long")
    for b in range(blocks):
        got = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).select(key, vector).toPandas()
        if not len(got):
            continue
        ids = got[key].to_numpy()
        q = np.stack(got[vector].to_numpy()).astype(np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-10)

        def scan(batches: Iterator[pd.DataFrame], ids: np.ndarray = ids, q: np.ndarray = q) -> Iterator[pd.DataFrame]:
            counts = np.zeros(len(q), np.int64)
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
                    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
                    counts += ((np.round(q @ x.T, 6) >= least) & (ids[:, None] != pdf[key].to_numpy()[None, :])).sum(1)
            yield pd.DataFrame({"query": ids, "c": counts})

        out = out.unionByName(base.select(key, vector).mapInPandas(scan, f"query {kind}, c long"))
    return out.groupBy("query").agg(F.sum("c").alias("near")).where("near > 0")


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector of each group, renormalised: one aggregation over (group, dimension)."""
    per = df.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    one = per.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))
    return one.withColumn("centroid", M.normalised(F.col("centroid")))


def nearest_centroid(df: DataFrame, key: str, vector: str, centres: DataFrame, group: str, block: int = 10_000) -> DataFrame:
    """Nearest centroid by Euclidean distance, ties to the smaller group; centres go to the tasks in blocks of about ``block``."""
    centres = stage(centres.select(group, "centroid"), "centres")
    blocks = max(1, -(-centres.count() // block))
    kinds = dict(df.dtypes) | dict(centres.dtypes)
    schema, parts = f"{key} {kinds[key]}, nearest {kinds[group]}, distance double", []
    for b in range(blocks):
        got = centres.where(F.pmod(F.xxhash64(group), F.lit(blocks)) == b).toPandas().sort_values(group)
        if not len(got):
            continue
        c, names = np.stack(got["centroid"].to_numpy()).astype(np.float64), got[group].to_numpy()

        def run(batches: Iterator[pd.DataFrame], c: np.ndarray = c, names: np.ndarray = names) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
                dist = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None, :]
                i = np.round(dist, 9).argmin(1)
                yield pd.DataFrame({key: pdf[key], "nearest": names[i], "distance": np.round(np.sqrt(np.maximum(dist[np.arange(len(x)), i], 0)), 5)})

        parts.append(df.select(key, vector).mapInPandas(run, schema))
    if len(parts) < 2:
        return parts[0] if parts else df.sparkSession.createDataFrame([], schema)
    best = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.min(F.struct("distance", "nearest")).alias("m"))
    return best.select(key, F.col("m.nearest").alias("nearest"), F.col("m.distance").alias("distance"))


def bm25(docs: DataFrame, queries: DataFrame, key: str, words: str, query: str, query_words: str, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """BM25 through an inverted index: only postings of words that queries have are joined; scores relative to the query's best.

    The join is on the word, so a word in most documents and queries meets all of both: adaptive execution splits such a word's rows over
    tasks, but their number is a product, which every exact ranking with positive weights for frequent words has to count."""
    terms = docs.select(F.col(key).alias("key"), F.explode(words).alias("w")).where("w != ''").groupBy("key", "w").agg(F.count("*").alias("tf"))
    asked = queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(query_words)).alias("w")).where("w != ''")
    wanted = asked.select("w").distinct()
    lengths = docs.select(F.col(key).alias("key"), F.size(F.filter(words, lambda w: w != "")).alias("len"))
    stats = lengths.agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("avg"))
    post = terms.join(wanted, "w", "left_semi")
    df_ = post.groupBy("w").agg(F.count("*").alias("df"))
    j = asked.join(df_, "w").join(post, "w").join(lengths, "key").join(F.broadcast(stats))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    one = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    scored = j.groupBy("query", "key").agg(F.round(F.sum(one), 6).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    top = scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return top.withColumn("relative", F.round(F.col("score") / F.max("score").over(Window.partitionBy("query")), 6))


def keywords(df: DataFrame, group: str, words: Column, k: int = 12, stop: list[str] | None = None) -> DataFrame:
    """Telling words of each group: tf * ln((T + 1) / (df + 1)), T the number of groups, df groups with the word."""
    t = df.select(F.col(group).alias("g"), F.explode(words).alias("w")).where((F.length("w") > 2) & ~F.col("w").isin(stop or [""]))
    tf = t.groupBy("g", "w").agg(F.count("*").alias("tf"))
    dfs = tf.groupBy("w").agg(F.count("*").alias("df"))
    n = tf.agg(F.count_distinct("g").alias("t"))
    s = tf.join(dfs, "w").join(F.broadcast(n)).withColumn("score", F.round(F.col("tf") * F.log((F.col("t") + 1) / (F.col("df") + 1)), 6))
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), "w"))
    return s.withColumn("place", place).where(F.col("place") <= k).select(F.col("g").alias(group), "w", "score", F.col("place").cast("bigint").alias("place"))


def hybrid(vector_hits: DataFrame, word_hits: DataFrame, entity: DataFrame, weights: tuple[float, float, float] = (0.5, 0.3, 0.2), first: int = 20, k: int = 5, least: float = 0.0) -> DataFrame:
    """0.5 cosine + 0.3 relative BM25 + 0.2 entity overlap; entities only for the ``first`` by the other two."""
    h = vector_hits.select("query", "key", "cosine").join(word_hits.select("query", "key", "relative"), ["query", "key"], "full").na.fill(0.0, ["cosine", "relative"])
    h = h.withColumn("early", weights[0] * F.col("cosine") + weights[1] * F.col("relative"))
    h = h.withColumn("_p", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("early"), "key"))).where(F.col("_p") <= first)
    h = h.join(entity, ["query", "key"], "left").na.fill(0.0, ["overlap"]).withColumn("score", F.round(F.col("early") + weights[2] * F.col("overlap"), 6)).where(F.col("score") >= least)
    return h.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))).where(F.col("place") <= k).select("query", "key", "score", "place")
