"""Cleaning and features: keys and duplicates, time, text patterns, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import maths as M
from tideline.functions import text as X
from tideline.functions import time as T
from tideline.operators import dedup, ranking
from tideline.plans._register import Plans
from tideline.sources.tables import table

PLANS = Plans()
_W = r"[\p{L}\p{N}_]"
_SQUEEZE = "regexp_replace(regexp_replace({}, '\\s+', ' ', 'g'), '^ +| +$', '', 'g')"


def _sql_any(column: str, patterns: list[str]) -> str:
    joined = "|".join(f"(?:{p})" for p in patterns).replace("'", "''")
    return f"regexp_matches({column}, '{joined}')"


_SQL_CLEAN = _SQUEEZE.format(f"regexp_replace(regexp_replace(regexp_replace(text, 'https?://\\S+', '', 'g'), '@{_W}+', '', 'g'), '#', '', 'g')")
_SQL_TOPIC = _SQUEEZE.format(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://\\S+', ' ', 'g'), '@{_W}+', ' ', 'g'), '#', '', 'g'), '[^\\x00-\\x7F]', ' ', 'g')")


@PLANS("SELECT DISTINCT tweet_id, user_id, cluster_id, text, created_at FROM tweets")
def st02_distinct_rows(s, d):
    return dedup.distinct_rows(table(s, d, "tweets").select("tweet_id", "user_id", "cluster_id", "text", "created_at"))


@PLANS("""SELECT tweet_id, retweet_count_at_collection AS rt, likes_at_collection AS likes, collected_at FROM (
SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY retweet_count_at_collection + likes_at_collection DESC, collected_at DESC) AS k FROM tweets) WHERE k = 1""")
def wn20_highest_engagement(s, d):
    """WN20, ST03: one row a key, the one with most engagement."""
    order = [F.desc(F.col("retweet_count_at_collection") + F.col("likes_at_collection")), F.desc("collected_at")]
    t = table(s, d, "tweets").select("tweet_id", "retweet_count_at_collection", "likes_at_collection", "collected_at")
    return dedup.highest_by_key(t, "tweet_id", order).select("tweet_id", F.col("retweet_count_at_collection").alias("rt"), F.col("likes_at_collection").alias("likes"), "collected_at")


@PLANS("SELECT sentence_id FROM (SELECT sentence_id, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY sentence_id) AS k FROM (SELECT DISTINCT sentence_id, text FROM normalizations)) WHERE k = 1")
def wn13_first_occurrence(s, d):
    """WN13, ST10: first row of each text."""
    one = table(s, d, "normalizations").select("sentence_id", "text").distinct()
    return dedup.occurrence(one, dedup.text_key(F.col("text")), ["sentence_id"]).where("occurrence = 1").select("sentence_id")


@PLANS("SELECT tweet_id, created_at, round(ln(likes_at_collection + 1), 6) AS log_likes, round(ln(retweet_count_at_collection + 1) + ln(likes_at_collection + 1), 6) AS log_engagement FROM tweets")
def ma01_log_engagement(s, d):
    likes, rt = F.log(F.col("likes_at_collection") + 1), F.log(F.col("retweet_count_at_collection") + 1)
    return table(s, d, "tweets").select("tweet_id", "created_at", F.round(likes, 6).alias("log_likes"), F.round(rt + likes, 6).alias("log_engagement"))


@PLANS("""SELECT tweet_id, collected_at, round(retweet_count_at_collection / (likes_at_collection + 1.0), 6) AS rt_per_like, round(likes_at_collection / greatest(1, length(text))::DOUBLE, 6) AS likes_per_char, round(likes_at_collection / greatest(1, user_followers_count)::DOUBLE, 6) AS reach FROM tweets""")
def ma02_ratios(s, d):
    likes, rt = F.col("likes_at_collection"), F.col("retweet_count_at_collection")
    return table(s, d, "tweets").select("tweet_id", "collected_at", F.round(M.smoothed(rt, likes), 6).alias("rt_per_like"), F.round(M.guarded(likes, F.length("text")), 6).alias("likes_per_char"), F.round(likes / F.greatest(F.lit(1), F.col("user_followers_count")).cast("double"), 6).alias("reach"))


@PLANS("SELECT tweet_id, collected_at, round((rank() OVER (ORDER BY likes_at_collection) + (count(*) OVER (PARTITION BY likes_at_collection) - 1) / 2.0) / count(*) OVER (), 6) AS pct_rank FROM tweets")
def wn14_average_rank(s, d):
    t = table(s, d, "tweets").select("tweet_id", "collected_at", "likes_at_collection")
    return ranking.average_rank_by_counts(t, "likes_at_collection").select("tweet_id", "collected_at", F.round("pct_rank", 6).alias("pct_rank"))


@PLANS("""WITH r AS (SELECT sentence_id, model, confidence, length(coalesce(raw_response, '')) AS n FROM (SELECT DISTINCT sentence_id, model, confidence, raw_response FROM predictions WHERE confidence IS NOT NULL))
SELECT sentence_id, model, round(((rank() OVER (PARTITION BY model ORDER BY confidence) + (count(*) OVER (PARTITION BY model, confidence) - 1) / 2.0) / count(*) OVER (PARTITION BY model)
+ (rank() OVER (PARTITION BY model ORDER BY n) + (count(*) OVER (PARTITION BY model, n) - 1) / 2.0) / count(*) OVER (PARTITION BY model)) / 2, 6) AS mean_rank FROM r""")
def wn15_mean_of_ranks(s, d):
    p = table(s, d, "predictions").where("confidence is not null").select("sentence_id", "model", "confidence", "raw_response").distinct().withColumn("n", F.length(F.coalesce("raw_response", F.lit(""))))
    return p.select("sentence_id", "model", F.round((ranking.average_rank("confidence", "model") + ranking.average_rank("n", "model")) / 2, 6).alias("mean_rank"))


@PLANS("""SELECT tweet_id, created_at, year(created_at) AS y, week(created_at) AS iso_week, (day(created_at) - 1) // 7 + 1 AS week_of_month, isodow(created_at) AS weekday, hour(created_at) AS h, strftime(created_at, '%Y-%m') AS ym,
isodow(created_at) >= 6 AS is_weekend, isodow(created_at) >= 5 AS is_weekend_compat, hour(created_at) >= 6 AND hour(created_at) < 12 AS is_morning, hour(created_at) >= 18 AS is_evening FROM tweets""")
def dt04_calendar(s, d):
    """DT04, DT06: calendar parts and parts of the day."""
    at = F.col("created_at")
    c = T.calendar(at)
    big = lambda x: x.cast("bigint")
    return table(s, d, "tweets").select("tweet_id", "created_at", big(c["year"]).alias("y"), big(c["iso_week"]).alias("iso_week"), big(c["week_of_month"]).alias("week_of_month"), big(c["weekday"]).alias("weekday"), big(c["hour"]).alias("h"), c["year_month"].alias("ym"), *[v.alias(k) for k, v in T.day_parts(at).items()])


@PLANS("SELECT tweet_id, collected_at, date_trunc('hour', created_at) AS h, date_trunc('day', created_at) AS day, date_trunc('week', created_at) AS w, date_trunc('month', created_at) AS m FROM tweets")
def dt03_truncate(s, d):
    cut = lambda u: F.date_trunc(u, "created_at").cast("timestamp_ntz")
    return table(s, d, "tweets").select("tweet_id", "collected_at", cut("hour").alias("h"), cut("day").alias("day"), cut("week").alias("w"), cut("month").alias("m"))


@PLANS("""SELECT tweet_id, collected_at, date_diff('second', created_at, collected_at) / 3600.0 AS lead_hours, CAST(floor(date_diff('second', user_join_date, created_at) / 86400.0) AS BIGINT) AS account_days FROM
(SELECT tweet_id, date_trunc('second', created_at) AS created_at, date_trunc('second', collected_at) AS collected_at, date_trunc('second', user_join_date) AS user_join_date FROM tweets)""")
def dt07_lead_and_age(s, d):
    """DT07, DT08: hours between two times, whole days of an account."""
    t = table(s, d, "tweets").select("tweet_id", *[F.date_trunc("second", c).cast("timestamp_ntz").alias(c) for c in ("created_at", "collected_at", "user_join_date")])
    return t.select("tweet_id", "collected_at", (T.seconds_between(F.col("created_at"), F.col("collected_at")) / 3600.0).alias("lead_hours"), F.floor(T.seconds_between(F.col("user_join_date"), F.col("created_at")) / 86400.0).alias("account_days"))


@PLANS("""SELECT tweet_id, collected_at, strptime(strftime(created_at, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS parsed, date_trunc('second', created_at) + INTERVAL 5 HOUR AS from_est, date_trunc('second', created_at) + INTERVAL 4 HOUR AS from_edt FROM tweets""")
def dt01_parse_and_shift(s, d):
    """DT01, DT02: written timestamps with a zone name, and eastern time to UTC."""
    w = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")
    return table(s, d, "tweets").select("tweet_id", "collected_at", T.parse_timestamp(F.concat(w, F.lit(" UTC"))).alias("parsed"), T.eastern_to_utc(F.concat(w, F.lit(" EST"))).alias("from_est"), T.eastern_to_utc(F.concat(w, F.lit(" EDT"))).alias("from_edt"))


@PLANS(f"SELECT DISTINCT tweet_id, {_SQL_TOPIC} AS cleaned FROM tweets")
def sf01_topic_clean(s, d):
    return table(s, d, "tweets").select("tweet_id", X.topic_clean(F.col("text")).alias("cleaned")).distinct()


@PLANS(f"SELECT DISTINCT tweet_id, {_SQL_CLEAN} AS cleaned, " + _SQUEEZE.format(f"regexp_replace(regexp_replace(text, 'https?://\\S+', '', 'g'), '@{_W}+', '', 'g')") + " AS minimal FROM tweets")
def sf02_gate_clean(s, d):
    """SF02, SF05."""
    c = F.col("text")
    return table(s, d, "tweets").select("tweet_id", X.gate_clean(c).alias("cleaned"), X.minimal_clean(c).alias("minimal")).distinct()


@PLANS()
def sf03_tweet_clean(s, d):
    """SF03, SF06, SF07, SF16: entities, handles, repeats, contractions, slang, hashtags; back-references have no RE2 equivalent."""
    c = F.col("text")
    return table(s, d, "tweets").select("tweet_id", X.tweet_clean(c).alias("cleaned"), X.expand_slang(X.expand_contractions(c)).alias("expanded"), X.segment_hashtags(c).alias("segmented"), X.preprocess(c, contractions=True, emojis=True).alias("plain"), F.regexp_count(c, F.lit(r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]")).alias("emoji_count")).distinct()


@PLANS()
def sf04_normalised_forms(s, d):
    """SF03, SF04: compatibility forms (NFKC) and plain ASCII (NFKD without marks); Arrow batches, as SQL has no normaliser."""
    from tideline.functions.unicode import ascii_form, compatibility_form

    return table(s, d, "normalizations").select("sentence_id", "text").distinct().select("sentence_id", compatibility_form("text").alias("nfkc"), ascii_form("text").alias("ascii"))


@PLANS(f"""SELECT DISTINCT tweet_id, len(regexp_extract_all(text, '@{_W}+')) AS mention_count, starts_with(text, '@') AS is_reply_tweet, regexp_matches(text, '^RT @') AS is_manual_retweet, regexp_matches(text, '(?i)via @') AS has_via_attribution,
contains(text, '?') AS has_question, contains(text, '!') AS has_exclamation, regexp_matches(text, '\\d') AS has_numbers, regexp_matches(text, '[$€£]\\d|\\d%') AS has_stats, regexp_matches(text, '\\.{{3}}$|…$') AS is_truncated,
len(regexp_extract_all(text, '#{_W}+')) > 5 AS excessive_hashtags, regexp_matches(text, 'https?://\\S+') AS has_urls, len(regexp_extract_all(text, 'https?://\\S+')) > 2 AS has_many_urls,
len(list_filter(string_split_regex(text, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_matches(x, '^[A-Z]{{3,}}$') AND x NOT IN ({", ".join(f"'{a}'" for a in X.ACRONYMS)}))) > 0 AS has_all_caps FROM tweets""")
def sf09_pattern_flags(s, d):
    flags = X.pattern_flags(F.col("text"))
    flags["mention_count"] = flags["mention_count"].cast("bigint")
    return table(s, d, "tweets").select("tweet_id", *[v.alias(k) for k, v in flags.items() if k != "has_cashtags"]).distinct()


@PLANS(f"""WITH f AS (SELECT tweet_id, CAST(regexp_matches(text, '\\$[A-Za-z]{{1,6}}\\b') AS INT) + CAST(regexp_matches(text, 'https?://\\S+') AS INT) + 2 * CAST(len(regexp_extract_all(text, 'https?://\\S+')) > 2 AS INT) + 2 * CAST(len(regexp_extract_all(text, '#{_W}+')) > 5 AS INT)
+ 2 * CAST(regexp_matches(text, '^RT @') AS INT) + CAST(len(list_filter(string_split_regex(text, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_matches(x, '^[A-Z]{{3,}}$') AND x NOT IN ({", ".join(f"'{a}'" for a in X.ACRONYMS)}))) > 0 AS INT) + CAST(len(regexp_extract_all(text, '@{_W}+')) > 3 AS INT) - CAST(starts_with(text, '@') AS INT) AS raw FROM tweets)
SELECT DISTINCT tweet_id, least(greatest(raw, 0), 20) AS bot_score, raw >= 4 AS is_bot_like FROM f""")
def prj15_bot_score(s, d):
    score = X.bot_score(X.pattern_flags(F.col("text")))
    return table(s, d, "tweets").select("tweet_id", score.alias("bot_score"), (score >= 4).alias("is_bot_like")).distinct()


def _features_sql() -> str:
    parts = [f"{_sql_any('low', v)} AS {k}" for k, v in X.LOWER_FEATURES.items()] + [f"{_sql_any('text', v)} AS {k}" for k, v in X.CASED_FEATURES.items()]
    numbers = X.SPELLED_NUMBERS.replace("'", "''")
    return f"""WITH t AS (SELECT DISTINCT sentence_id, text, lower(text) AS low, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS sq FROM normalizations),
    f AS (SELECT sentence_id, {", ".join(parts)}, regexp_matches(text, '\\d+') OR regexp_matches(low, '{numbers}') AS has_number, len(regexp_extract_all(text, '\\d+')) + len(regexp_extract_all(low, '{numbers}')) AS number_count, rtrim(text) LIKE '%?' AS is_question,
    CASE WHEN sq = '' THEN 0 ELSE len(string_split(sq, ' ')) END AS word_count, CASE WHEN sq = '' THEN 0.0 ELSE round(length(regexp_replace(text, '\\s+', '', 'g')) / len(string_split(sq, ' '))::DOUBLE, 2) END AS avg_word_length,
    CASE WHEN length(text) = 0 THEN 0.0 ELSE round(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / length(text)::DOUBLE, 3) END AS alpha_ratio FROM t)
    SELECT *, has_number AND (has_specific_year OR has_relative_time) AS has_number_and_time, has_number AND has_comparative AS has_number_and_comparative, has_increase_decrease AND (has_specific_year OR has_relative_time) AS has_change_and_time,
    (has_source_attribution OR has_evidence_noun OR has_official_source) AND has_number AS has_source_and_number FROM f"""


@PLANS(_features_sql())
def sf10_linguistic_features(s, d):
    """35 features in one projection; nothing is shuffled but the distinct of the input."""
    f = X.linguistic_features(F.col("text"))
    for k in ("number_count", "word_count"):
        f[k] = f[k].cast("bigint")
    return table(s, d, "normalizations").select("sentence_id", "text").distinct().select("sentence_id", *[v.alias(k) for k, v in f.items()])


@PLANS(f"""WITH t AS (SELECT DISTINCT sentence_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS sq, regexp_replace(text, '[^\\p{{L}}]', '', 'g') AS letters, len(regexp_extract_all(text, '[.!?]+(?:\\s|$)')) AS sentence_count FROM normalizations), w AS (SELECT *, CASE WHEN sq = '' THEN 0 ELSE len(string_split(sq, ' ')) END AS word_count FROM t)
SELECT sentence_id, word_count <= 8 AND NOT regexp_matches(lower(text), '{X.STATEMENT_VERBS}') AS is_fragment, length(text) > 500 AS is_long, sentence_count > 1 AS is_compound, length(letters) >= 5 AND length(regexp_replace(letters, '[^\\p{{Lu}}]', '', 'g')) > 0.8 * length(letters) AS is_all_caps,
word_count >= 2 AND len(list_filter(string_split(sq, ' '), lambda x: x LIKE '@%' OR x LIKE '#%')) > 0.5 * word_count AS is_mostly_tags, upper(trim(text)) LIKE 'RT %' AS is_retweet, rtrim(text) LIKE '%?' AS is_question, regexp_matches(text, '\\d+') AS has_numbers, word_count, length(text) AS char_count, sentence_count,
CASE WHEN length(text) = 0 THEN 0.0 ELSE round(length(letters) / length(text)::DOUBLE, 3) END AS alpha_ratio FROM w""")
def sf11_quality_flags(s, d):
    f = X.quality_flags(F.col("text"))
    for k in ("word_count", "char_count", "sentence_count"):
        f[k] = f[k].cast("bigint")
    return table(s, d, "normalizations").select("sentence_id", "text").distinct().select("sentence_id", *[v.alias(k) for k, v in f.items()])


@PLANS("""WITH t AS (SELECT DISTINCT sentence_id, text, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS n FROM normalizations)
SELECT sentence_id, concat_ws('|', CASE WHEN contains(text, '#NAME?') OR contains(text, '#REF!') OR contains(text, '#VALUE!') OR contains(text, '#DIV/0!') OR contains(text, '#NULL!') OR contains(text, '#N/A') OR text = '' THEN 'corrupted' END, CASE WHEN n < 3 THEN 'too_short' END, CASE WHEN length(text) > 500 THEN 'too_long' END) AS reason FROM t""")
def sf12_exclusion_reason(s, d):
    return table(s, d, "normalizations").select("sentence_id", "text").distinct().select("sentence_id", X.exclusion_reason(F.col("text")).alias("reason"))


def _gate_sql() -> str:
    return f"""WITH t AS (SELECT tweet_id, text, {_SQL_CLEAN} AS c FROM tweets), w AS (SELECT *, CASE WHEN c = '' THEN 0 ELSE len(string_split(c, ' ')) END AS n FROM t)
    SELECT DISTINCT tweet_id, CASE WHEN text IS NULL OR {_SQUEEZE.format("text")} = '' THEN 'empty' WHEN c = '' THEN 'empty_after_clean' WHEN n < 4 THEN 'too_short_' || n || '_words' WHEN n > 150 THEN 'too_long_' || n || '_words'
    WHEN regexp_matches(lower(c), '{X.REACTION_START}') OR regexp_matches(c, '^[^\\p{{L}}\\p{{N}}_\\s]*$') THEN 'reaction' ELSE '' END AS reason FROM w"""


@PLANS(_gate_sql())
def sf14_stream_gate(s, d):
    return X.with_stream_gate(table(s, d, "tweets").select("tweet_id", "text"), "text").select("tweet_id", "reason").distinct()


@PLANS(f"""WITH g AS ({_gate_sql()}) SELECT CASE WHEN reason = '' THEN 'pass' ELSE regexp_replace(reason, '_\\d+_words$', '') END AS outcome, count(*) AS n FROM g GROUP BY 1""")
def ag34_gate_stats(s, d):
    g = sf14_stream_gate(s, d)
    return g.groupBy(F.when(F.col("reason") == "", "pass").otherwise(F.regexp_replace("reason", r"_\d+_words$", "")).alias("outcome")).agg(F.count("*").alias("n"))


@PLANS(f"""WITH t AS (SELECT tweet_id, trim(text) AS t, CASE WHEN {_SQUEEZE.format("text")} = '' THEN 0 ELSE len(string_split({_SQUEEZE.format("text")}, ' ')) END AS n FROM tweets)
SELECT DISTINCT tweet_id, CASE WHEN t IS NULL THEN 'null_or_invalid' WHEN length(t) < 20 THEN 'too_short_chars' WHEN n < 5 THEN 'too_few_words' WHEN n > 100 THEN 'too_many_words' WHEN t LIKE '%?' OR regexp_matches(lower(t), '^(who|what|where|when|why|how) ') THEN 'is_question'
WHEN regexp_matches(lower(t), '^(lol|lmao|omg|wow|haha|hahaha|yes|no|ok|okay|thanks|thank you|congrats|congratulations)!*$|^(great|awesome|amazing|cool|nice)!*$') THEN 'is_reaction' WHEN NOT regexp_matches(lower(t), '{X.STATEMENT_VERBS}') THEN 'no_verb' ELSE 'passed' END AS reason FROM t""")
def sf15_batch_gate(s, d):
    return table(s, d, "tweets").select("tweet_id", X.batch_gate(F.col("text")).alias("reason")).distinct()


@PLANS()
def sf17_language(s, d):
    """SF17: language of documents by stop-word votes on the JVM, and whether the stored one agrees after folding its spelling."""
    from tideline.functions.language import guess

    lang = F.lower(F.substring(F.col("lang"), 1, 2))
    return table(s, d, "documents").select("doc_id", guess(F.col("text")).alias("guess"), lang.alias("stored")).withColumn("agrees", F.col("guess") == F.col("stored"))


@PLANS()
def sf18_entities(s, d):
    """SF18: entities of text and claim and their overlap."""
    n = table(s, d, "normalizations").where("normalized_claim is not null").select("sentence_id", "model_name", "text", "normalized_claim").distinct()
    a, b = X.entities(F.col("text")), X.entities(F.col("normalized_claim"))
    return n.select("sentence_id", "model_name", F.size(a).alias("in_text"), F.size(b).alias("in_claim"), F.round(X.jaccard(a, b, 0.5), 6).alias("overlap"))


@PLANS()
def sf19_postprocess(s, d):
    return table(s, d, "normalizations").where("normalized_claim is not null").select("sentence_id", "model_name", X.postprocess_claim(F.col("normalized_claim")).alias("claim")).distinct()


@PLANS("""WITH k AS (SELECT cluster_id, tweet_id, text, row_number() OVER (PARTITION BY cluster_id ORDER BY tweet_id) AS k FROM (SELECT tweet_id, min(cluster_id) AS cluster_id, min(text) AS text FROM tweets WHERE cluster_id >= 0 GROUP BY tweet_id))
SELECT cluster_id, string_agg(k || '. ' || CASE WHEN length(text) > 280 THEN substring(text, 1, 280) || '...' ELSE text END, chr(10) ORDER BY k) AS prompt FROM k WHERE k <= 5 GROUP BY cluster_id""")
def sf20_prompt_list(s, d):
    """SF20, SR04: first five texts of each cluster as a numbered list."""
    one = table(s, d, "tweets").where("cluster_id >= 0").groupBy("tweet_id").agg(F.min("cluster_id").alias("cluster_id"), F.min("text").alias("text"))
    top = ranking.top_per_group(one, ["cluster_id"], ["tweet_id"], 5, "k")
    return top.groupBy("cluster_id").agg(X.numbered_list(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"])).alias("prompt"))


@PLANS("SELECT sentence_id, regexp_extract(claim, 'CLAIM: (.*?) SOURCE:', 1) AS claim, regexp_extract(claim, 'SOURCE: \"(.*?)\"', 1) AS source FROM (SELECT DISTINCT sentence_id, 'CLAIM: ' || replace(normalized_claim, chr(10), ' ') || ' SOURCE: \"' || model_name || '\"' AS claim FROM normalizations WHERE normalized_claim IS NOT NULL)")
def sf21_parse_response(s, d):
    n = table(s, d, "normalizations").where("normalized_claim is not null")
    c = F.concat(F.lit("CLAIM: "), F.replace("normalized_claim", F.lit("\n"), F.lit(" ")), F.lit(' SOURCE: "'), F.col("model_name"), F.lit('"'))
    return n.select("sentence_id", c.alias("c")).distinct().select("sentence_id", F.regexp_extract("c", "CLAIM: (.*?) SOURCE:", 1).alias("claim"), F.regexp_extract("c", 'SOURCE: "(.*?)"', 1).alias("source"))


@PLANS("SELECT sentence_id, array_to_string(list_slice(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(low, '{p}') THEN '{k}' END" for k, p in X.TOPIC_PATTERNS.items()) + "], lambda x: x IS NOT NULL), 1, 2), '|') AS topics FROM (SELECT DISTINCT sentence_id, lower(text) AS low FROM normalizations)")
def sf22_topics(s, d):
    return table(s, d, "normalizations").select("sentence_id", "text").distinct().select("sentence_id", F.array_join(X.topics(F.col("text")), "|").alias("topics")).distinct()


@PLANS("SELECT CAST(substring(sentence_id, 1, 4) AS BIGINT) AS year, label, count(*) AS n FROM (SELECT DISTINCT sentence_id, label FROM normalizations) WHERE regexp_matches(sentence_id, '^\\d{4}') AND CAST(substring(sentence_id, 1, 4) AS BIGINT) BETWEEN 1980 AND 2025 GROUP BY 1, 2")
def sf24_year_from_id(s, d):
    """SF24, AG35: year from an id, counts per year and label."""
    n = table(s, d, "normalizations").select("sentence_id", "label").distinct().withColumn("year", F.regexp_extract("sentence_id", r"^(\d{4})", 1).try_cast("bigint"))
    return n.where("year between 1980 and 2025").groupBy("year", "label").agg(F.count("*").alias("n"))


@PLANS("SELECT tweet_id, len(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x != '')) AS tokens, length(text) AS chars, strlen(text) AS bytes FROM (SELECT DISTINCT tweet_id, text FROM tweets)")
def sf25_tokens(s, d):
    """SF08, SF25."""
    t = table(s, d, "tweets").select("tweet_id", "text").distinct()
    return t.select("tweet_id", F.size(X.tokens(F.col("text"))).cast("bigint").alias("tokens"), F.length("text").cast("bigint").alias("chars"), F.octet_length("text").cast("bigint").alias("bytes"))


@PLANS("""WITH w AS (SELECT sentence_id, list_distinct(string_split_regex(lower(text), '\\s+')) AS w FROM (SELECT sentence_id, min(text) AS text FROM normalizations GROUP BY sentence_id))
SELECT a.sentence_id AS key_a, b.sentence_id AS key_b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE, 6) AS similarity FROM w a JOIN w b ON a.sentence_id < b.sentence_id
WHERE len(a.w) >= 0.8 * len(b.w) AND len(b.w) >= 0.8 * len(a.w) AND len(list_intersect(a.w, b.w)) >= 0.8 * len(list_distinct(list_concat(a.w, b.w)))""")
def jn14_jaccard_self_join(s, d):
    n = table(s, d, "normalizations").groupBy("sentence_id").agg(F.min("text").alias("text"))
    return dedup.jaccard_links(n.select("sentence_id", F.split(F.lower("text"), r"\s+").alias("w")), "sentence_id", "w", 0.8)
