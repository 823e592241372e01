"""Joins: content, labels, several keys, lookups, membership, semi and anti."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators.staging import stage  # noqa: F401 - part of the joins' toolbox
from tideline.plans._register import Plans
from tideline.sources.tables import table

PLANS = Plans()


@PLANS("SELECT t.tweet_id, t.collected_at, u.username, u.f FROM tweets t LEFT JOIN (SELECT user_id, min(username) AS username, max(followers_at_collection) AS f FROM users GROUP BY 1) u USING (user_id)")
def jn01_left_content(s, d):
    u = table(s, d, "users").groupBy("user_id").agg(F.min("username").alias("username"), F.max("followers_at_collection").alias("f"))
    return table(s, d, "tweets").select("tweet_id", "collected_at", "user_id").join(u, "user_id", "left").select("tweet_id", "collected_at", "username", "f")


@PLANS("SELECT p.sentence_id, p.model, p.predicted_label, n.label FROM (SELECT DISTINCT sentence_id, model, predicted_label FROM predictions) p LEFT JOIN (SELECT sentence_id, min(label) AS label FROM normalizations GROUP BY 1) n USING (sentence_id)")
def jn02_left_labels(s, d):
    """JN02, JN06."""
    n = table(s, d, "normalizations").groupBy("sentence_id").agg(F.min("label").alias("label"))
    return table(s, d, "predictions").select("sentence_id", "model", "predicted_label").distinct().join(n, "sentence_id", "left")


@PLANS("SELECT o.o_orderkey, l.l_linenumber, c.c_mktsegment FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_orderdate >= TIMESTAMP '1998-01-01'")
def jn03_inner(s, d):
    o = table(s, d, "orders").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_custkey")
    li, c = table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), table(s, d, "customer").select("c_custkey", "c_mktsegment")
    return o.join(li, o.o_orderkey == li.l_orderkey).join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "l_linenumber", "c_mktsegment")


@PLANS("SELECT r.sentence_id, r.module, p.model FROM (SELECT DISTINCT sentence_id, module FROM raw_responses) r JOIN (SELECT DISTINCT sentence_id, model, split FROM predictions) p USING (sentence_id) JOIN (SELECT DISTINCT sentence_id, split FROM normalizations) n ON n.sentence_id = r.sentence_id AND n.split = p.split")
def jn04_two_keys(s, d):
    r = table(s, d, "raw_responses").select("sentence_id", "module").distinct()
    p, n = table(s, d, "predictions").select("sentence_id", "model", "split").distinct(), table(s, d, "normalizations").select("sentence_id", "split").distinct()
    return r.join(p, "sentence_id").join(n, ["sentence_id", "split"]).select("sentence_id", "module", "model")


@PLANS("SELECT i, sentence_id, c FROM (SELECT row_number() OVER (ORDER BY sentence_id) - 1 AS i, sentence_id FROM (SELECT DISTINCT sentence_id FROM normalizations)) LEFT JOIN (SELECT sentence_id, max(confidence) AS c FROM predictions GROUP BY 1) USING (sentence_id) ORDER BY i")
def jn05_order_restoring(s, d):
    """JN05, JN07: positions are a column of a real key, so any join keeps them."""
    from tideline.operators.ranking import row_index

    i = row_index(table(s, d, "normalizations").select("sentence_id").distinct(), ["sentence_id"], "i")
    return i.join(table(s, d, "predictions").groupBy("sentence_id").agg(F.max("confidence").alias("c")), "sentence_id", "left").select("i", "sentence_id", "c").orderBy("i")


@PLANS("SELECT s.s_suppkey, n.n_name, r.r_name FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey")
def jn08_lookup(s, d):
    """Map-side lookup of fixed dimension tables (25 and 5 rows)."""
    sup, n, r = table(s, d, "supplier"), table(s, d, "nation"), table(s, d, "region")
    return sup.join(F.broadcast(n), sup.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("s_suppkey", "n_name", "r_name")


@PLANS("WITH c AS (SELECT user_id, list_distinct(list(cluster_id)) AS ids FROM tweets WHERE cluster_id >= 0 GROUP BY 1), e AS (SELECT user_id, unnest(ids) AS cluster_id FROM c) SELECT cluster_id, count(*) AS users FROM e GROUP BY 1")
def jn10_list_membership(s, d):
    c = table(s, d, "tweets").where("cluster_id >= 0").groupBy("user_id").agg(F.collect_set("cluster_id").alias("ids"))
    return c.select("user_id", F.explode("ids").alias("cluster_id")).groupBy("cluster_id").agg(F.count("*").alias("users"))


@PLANS("SELECT DISTINCT t.tweet_id FROM tweets t WHERE EXISTS (SELECT 1 FROM users u WHERE u.user_id = t.user_id AND u.verified)")
def jn11_semi(s, d):
    return table(s, d, "tweets").join(table(s, d, "users").where("verified"), "user_id", "left_semi").select("tweet_id").distinct()


@PLANS("SELECT DISTINCT i.tweet_id FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM tweets t WHERE lower(trim(t.text)) = lower(trim(i.text)))")
def jn12_anti_text(s, d):
    from tideline.operators.dedup import text_key

    i = table(s, d, "incoming").select("tweet_id", text_key(F.col("text")).alias("h"))
    return i.join(table(s, d, "tweets").select(text_key(F.col("text")).alias("h")), "h", "left_anti").select("tweet_id").distinct()


@PLANS("SELECT count(*) AS n, count(DISTINCT sentence_id) AS ids FROM (SELECT sentence_id, text FROM normalizations UNION ALL SELECT sentence_id, text FROM predictions)")
def st01_union(s, d):
    """ST01, PRJ09, SRC12: union by name."""
    u = table(s, d, "normalizations").select("sentence_id", "text").unionByName(table(s, d, "predictions").select("text", "sentence_id"))
    return u.agg(F.count("*").alias("n"), F.count_distinct("sentence_id").alias("ids"))


@PLANS("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def tp01_pricing_summary(s, d):
    li = table(s, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("disc"), F.count("*").alias("n"))


@PLANS("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def js02_json_path(s, d):
    e = table(s, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"))


@PLANS("WITH r AS (SELECT DISTINCT sentence_id, module, response_json FROM raw_responses WHERE json_valid(response_json)) SELECT sentence_id, module, json_extract_string(response_json, '$.confidence') AS confidence FROM r")
def js01_json_fields(s, d):
    from tideline.operators.parsing import valid_json

    r = table(s, d, "raw_responses").select("sentence_id", "module", "response_json").distinct()
    return r.where(valid_json(F.col("response_json"))).select("sentence_id", "module", F.get_json_object("response_json", "$.confidence").alias("confidence"))


@PLANS()
def js01_json_fallbacks(s, d):
    """JS01: four ways to read a response, first that works, with a flag where none does."""
    from tideline.operators.parsing import parse_response

    return parse_response(table(s, d, "raw_responses").select("sentence_id", "module", "response_json", "response_raw").distinct())


@PLANS()
def ma09_logprobs(s, d):
    """MA09: ternary probabilities, entropy and margin from token logprobs."""
    from tideline.operators.parsing import ternary

    return ternary(table(s, d, "raw_responses").where("logprobs is not null").select("sentence_id", "module", "logprobs").distinct())


@PLANS("SELECT tweet_id, len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS items, list_contains(string_split(lower(text), ' '), 'the') AS has_the FROM (SELECT DISTINCT tweet_id, text FROM tweets WHERE text != '')")
def ar01_list_lengths(s, d):
    """AR01-AR03, MP01: lists from strings, membership."""
    t = table(s, d, "tweets").where("text != ''").select("tweet_id", "text").distinct()
    return t.select("tweet_id", F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).cast("bigint").alias("items"), F.array_contains(F.split(F.lower("text"), " "), "the").alias("has_the"))
