"""The pN_ queries over whole tables, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import p1_splits, p2_unify, p3_pii, p4_edits, p5_pairs, p6_topn, p7_history, p8_pack, p9_leaks, p10_split
from tideline.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return p1_splits.found(table(s, d, "normalizations"))


def p1_report(s: SparkSession, d: str) -> DataFrame:
    return p1_splits.report(table(s, d, "normalizations"), table(s, d, "predictions"))


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return p2_unify.inconsistent(table(s, d, "tweets"), "tweet_id", "text")


def p2_forms(s: SparkSession, d: str) -> DataFrame:
    return p2_unify.unify(table(s, d, "tweets"), "tweet_id", "text").select(F.col("key").alias("tweet_id"), "form", "changed").distinct()


def p2_spellings(s: SparkSession, d: str) -> DataFrame:
    return p2_unify.spellings(table(s, d, "tweets"), "tweet_id", "text")


def p3_found(s: SparkSession, d: str) -> DataFrame:
    given = p3_pii.given_names(table(s, d, "name_list"))
    return p3_pii.found(table(s, d, "tweets"), "tweet_id", "text", "tweets", given).unionByName(p3_pii.found(table(s, d, "posts"), "idx", "post", "posts", given))


def p3_replaced(s: SparkSession, d: str) -> DataFrame:
    given = p3_pii.given_names(table(s, d, "name_list"))
    tables = [("tweets", table(s, d, "tweets"), "tweet_id", "text"), ("posts", table(s, d, "posts"), "idx", "post")]
    return p3_pii.replaced(tables, given, session_secret(s)).distinct()


def session_secret(s: SparkSession) -> str:
    """The secret of the surrogates: ``tideline.pii.secret`` of the session, or one made for this session alone."""
    if not s.conf.get("tideline.pii.secret", None):
        s.conf.set("tideline.pii.secret", secrets.token_hex(32))
    return s.conf.get("tideline.pii.secret")


def p4_found(s: SparkSession, d: str) -> DataFrame:
    pairs = p4_edits.pairs_of_keys(*p4_edits.near_duplicates(table(s, d, "tweets"), "tweet_id", "text"))
    return pairs.select(F.col("key_a").alias("tweet_id_a"), F.col("key_b").alias("tweet_id_b"))


def p4_groups(s: SparkSession, d: str) -> DataFrame:
    return p4_edits.groups(table(s, d, "tweets"), "tweet_id", "text").withColumnRenamed("key", "tweet_id")


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return p5_pairs.found(table(s, d, "raw_responses"), table(s, d, "normalizations"))


def p5_report(s: SparkSession, d: str) -> DataFrame:
    return p5_pairs.report(table(s, d, "raw_responses"), table(s, d, "normalizations"))


def p6_found(s: SparkSession, d: str) -> DataFrame:
    top = p6_topn.top_n(table(s, d, "tweets"), "cluster_id", "tweet_id", "cluster_similarity", 5)
    return top.select(F.col("g").cast("int").alias("cluster_id"), F.col("item").alias("tweet_id"))


def p7_found(s: SparkSession, d: str) -> DataFrame:
    new, tweets, norm = table(s, d, "incoming"), table(s, d, "tweets"), table(s, d, "normalizations")
    text = p7_history.known_in(new, "tweet_id", "batch_id", "text", [(tweets, "tweet_id", "text")])
    claim = p7_history.known_in(new, "tweet_id", "batch_id", "normalized_claim", [(norm, "sentence_id", "normalized_claim")])
    return text.select(F.col("key").alias("tweet_id"), F.lit("text").alias("field")).unionByName(claim.select(F.col("key").alias("tweet_id"), F.lit("normalized_claim").alias("field")))


def p8_containers(s: SparkSession, d: str) -> DataFrame:
    return p8_pack.packed(table(s, d, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def p8_fill(s: SparkSession, d: str) -> DataFrame:
    return p8_pack.fill(p8_containers(s, d))


def p9_found(s: SparkSession, d: str) -> DataFrame:
    return p9_leaks.found(table(s, d, "documents"), table(s, d, "heldout_items"))


def p9_report(s: SparkSession, d: str) -> DataFrame:
    return p9_leaks.report(table(s, d, "documents"), table(s, d, "heldout_items"))


def p10_found(s: SparkSession, d: str) -> DataFrame:
    return p10_pieces(s, d).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")


def p10_pieces(s: SparkSession, d: str) -> DataFrame:
    return p10_split.pieces(table(s, d, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (p1_found, p1_report, p2_found, p2_forms, p2_spellings, p3_found, p3_replaced, p4_found, p4_groups, p5_found, p5_report, p6_found, p7_found, p8_containers, p8_fill, p9_found, p9_report, p10_found, p10_pieces)
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": """
            WITH one AS (
                SELECT cluster_id, tweet_id, max(cluster_similarity) AS score FROM tweets
                WHERE cluster_id >= 0 AND tweet_id IS NOT NULL AND cluster_similarity IS NOT NULL AND NOT isnan(cluster_similarity)
                GROUP BY cluster_id, tweet_id
            ), placed AS (
                SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, tweet_id) AS place FROM one
            )
            SELECT cluster_id, tweet_id FROM placed WHERE place <= 5
        """,
    }
