"""Evaluation of predictions: metrics, calibration, sweeps, tests, ensembles, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import maths as M
from tideline.operators import evaluate as E
from tideline.plans._register import Plans
from tideline.sources.tables import table

PLANS = Plans()
_P = "p AS (SELECT sentence_id, model, max(lower(true_label)) = 'yes' AS y, max(lower(predicted_label)) = 'yes' AS yh, round(max(confidence) / 100.0, 6) AS c FROM predictions WHERE true_label IS NOT NULL AND predicted_label IS NOT NULL AND confidence IS NOT NULL GROUP BY 1, 2)"
_S = _P + ", q AS (SELECT *, CASE WHEN yh THEN 0.5 + c / 2 ELSE 0.5 - c / 2 END AS pr FROM p)"


def _calls(s, d):
    """One row a sentence and model: truth, call, confidence as a share, probability of yes."""
    p = table(s, d, "predictions").where("true_label is not null and predicted_label is not null and confidence is not null")
    g = p.groupBy("sentence_id", "model").agg((F.max(F.lower("true_label")) == "yes").alias("y"), (F.max(F.lower("predicted_label")) == "yes").alias("yh"), F.round(F.max("confidence") / 100.0, 6).alias("c"))
    return g.withColumn("pr", F.when(F.col("yh"), 0.5 + F.col("c") / 2).otherwise(0.5 - F.col("c") / 2))


@PLANS(f"""WITH {_P}, k AS (SELECT model, count(*) FILTER (y AND yh) AS tp, count(*) FILTER (NOT y AND yh) AS fp, count(*) FILTER (y AND NOT yh) AS fn, count(*) FILTER (NOT y AND NOT yh) AS tn FROM p GROUP BY model)
SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1, round(CASE WHEN 5 * tp + 4 * fn + fp = 0 THEN 0 ELSE 5 * tp / (5 * tp + 4 * fn + fp) END, 6) AS f2 FROM k""")
def ev01_confusion(s, d):
    """EV01, EV15."""
    return E.confusion(_calls(s, d), "y", "yh", ["model"])


@PLANS(f"WITH {_S}, b AS (SELECT least(CAST(floor(pr * 10) AS BIGINT), 9) AS b, count(*) AS n, avg(pr) AS conf, avg(CAST(y AS INT)) AS acc, sum((pr - CAST(y AS INT)) * (pr - CAST(y AS INT))) AS sq FROM (SELECT round(pr, 6) AS pr, y FROM q) GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(conf - acc)) / sum(n), 6) AS ece, round(sum(sq) / sum(n), 6) AS brier FROM b")
def ev02_calibration(s, d):
    """EV02, EV03, EV04."""
    return E.calibration_error(_calls(s, d), "pr", "y", 10)


@PLANS(f"WITH {_S}, t AS (SELECT * FROM (VALUES (0.3), (0.35), (0.4), (0.45), (0.5), (0.55), (0.6), (0.65), (0.7)) AS v(threshold)), pos AS (SELECT count(*) FILTER (y) AS pos FROM q), k AS (SELECT threshold, count(*) FILTER (y AND pr >= threshold::DOUBLE) AS tp, count(*) FILTER (pr >= threshold::DOUBLE) AS flagged FROM q, t GROUP BY 1) SELECT threshold::DOUBLE AS threshold, tp, flagged, round(CASE WHEN pos + flagged = 0 THEN 0 ELSE 2.0 * tp / (pos + flagged) END, 6) AS f1 FROM k, pos")
def ud11_threshold_sweep(s, d):
    return E.threshold_sweep(_calls(s, d), "pr", "y", [0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7])


@PLANS(f"WITH {_S}, c AS (SELECT pr AS s, count(*) AS n, count(*) FILTER (y) AS k FROM q GROUP BY 1), r AS (SELECT s, sum(n) OVER (ORDER BY s DESC) AS pp, sum(k) OVER (ORDER BY s DESC) AS tp, sum(k) OVER () AS pos FROM c) SELECT s AS threshold, round(2.0 * tp / (pos + pp), 6) AS f1 FROM r ORDER BY f1 DESC, threshold DESC LIMIT 1")
def ud11_curve_optimum(s, d):
    return E.curve_optimum(_calls(s, d), "pr", "y")


_TWO = f"WITH {_P}, a AS (SELECT sentence_id, y = yh AS ok FROM p WHERE model = 'orla-7b-instruct'), b AS (SELECT sentence_id, y = yh AS ok FROM p WHERE model = 'quarz-large'), j AS (SELECT a.ok AS a, b.ok AS b FROM a JOIN b USING (sentence_id))"


def _pair(s, d):
    c = _calls(s, d).withColumn("ok", F.col("y") == F.col("yh"))
    a, b = c.where("model = 'orla-7b-instruct'").select("sentence_id", F.col("ok").alias("a")), c.where("model = 'quarz-large'").select("sentence_id", F.col("ok").alias("b"))
    return a.join(b, "sentence_id")


@PLANS(_TWO + ", k AS (SELECT count(*) FILTER (NOT a AND b) AS b01, count(*) FILTER (a AND NOT b) AS b10 FROM j) SELECT b01, b10, round(CASE WHEN b01 + b10 = 0 THEN 0 ELSE greatest(abs(b01 - b10) - 1, 0) * greatest(abs(b01 - b10) - 1, 0) / (b01 + b10) END, 6) AS chi2, round(CASE WHEN b10 = 0 THEN 0 ELSE b01 / b10 END, 6) AS odds FROM k")
def ev05_mcnemar(s, d):
    return E.mcnemar(_pair(s, d), "a", "b")


@PLANS()
def ev06_bootstrap(s, d):
    return E.bootstrap_mean(_calls(s, d).withColumn("hit", (F.col("y") == F.col("yh")).cast("double")).where("model = 'orla-7b-instruct'"), "sentence_id", "hit")


@PLANS(f"WITH {_P}, k AS (SELECT model, count(*) FILTER (y = yh) AS hits, count(*) AS n FROM p GROUP BY 1), w AS (SELECT *, hits / n::DOUBLE AS r, 3.8416 AS z2 FROM k) SELECT model, hits, n, round(greatest((r + z2 / (2 * n)) / (1 + z2 / n) - 1.96 * sqrt(r * (1 - r) / n + z2 / (4.0 * n * n)) / (1 + z2 / n), 0), 6) AS low, round(least((r + z2 / (2 * n)) / (1 + z2 / n) + 1.96 * sqrt(r * (1 - r) / n + z2 / (4.0 * n * n)) / (1 + z2 / n), 1), 6) AS high FROM w")
def ev07_wilson(s, d):
    k = _calls(s, d).groupBy("model").agg(F.count_if(F.col("y") == F.col("yh")).alias("hits"), F.count("*").alias("n"))
    low, high = M.wilson(F.col("hits"), F.col("n"))
    return k.select("model", "hits", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@PLANS(_TWO + ", k AS (SELECT avg(CAST(a AS INT)) AS p1, avg(CAST(b AS INT)) AS p2, stddev_samp(CAST(a AS INT)) AS s1, stddev_samp(CAST(b AS INT)) AS s2 FROM j) SELECT round(2 * asin(sqrt(p1)) - 2 * asin(sqrt(p2)), 6) AS h, round(CASE WHEN s1 = 0 AND s2 = 0 THEN 0 ELSE (p1 - p2) / sqrt((s1 * s1 + s2 * s2) / 2) END, 6) AS d FROM k")
def ev08_effect_sizes(s, d):
    i = lambda c: F.col(c).cast("int")
    k = _pair(s, d).agg(F.avg(i("a")).alias("p1"), F.avg(i("b")).alias("p2"), F.stddev_samp(i("a")).alias("s1"), F.stddev_samp(i("b")).alias("s2"))
    pooled = F.sqrt((F.col("s1") * F.col("s1") + F.col("s2") * F.col("s2")) / 2)
    return k.select(F.round(E.cohen_h(F.col("p1"), F.col("p2")), 6).alias("h"), F.round(M.ratio(F.col("p1") - F.col("p2"), pooled), 6).alias("d"))


@PLANS("WITH t AS (SELECT * FROM (VALUES ('a', 0.01), ('b', 0.04), ('c', 0.03)) AS v(name, p)), r AS (SELECT name, p::DOUBLE AS p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM t) SELECT name, p, round(0.05 / (m - k + 1), 6) AS holm, round(0.05 / m, 6) AS bonferroni, round(0.05 * k / m, 6) AS bh, min(CASE WHEN p <= 0.05 / (m - k + 1) THEN 1 ELSE 0 END) OVER (ORDER BY k) = 1 AS holm_significant, k <= (SELECT max(k) FROM r WHERE p <= 0.05 * k / m) AS bh_significant FROM r")
def ev09_corrections(s, d):
    return E.adjusted(s.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double"), "p")


@PLANS()
def ev10_power(s, d):
    rows = [(n, round(E.power_of_proportions(0.7, 0.8, n), 6), E.sample_size(0.7, 0.8), round(E.detectable_effect(n), 6)) for n in (50, 100, 200, 400)]
    return s.createDataFrame(rows, "n int, power double, n_for_80 int, mde double")


@PLANS(f"WITH {_P}, k AS (SELECT model, avg(CAST(y = yh AS INT)) AS acc FROM p GROUP BY 1) SELECT a.model AS a, b.model AS b, round(a.acc - b.acc, 6) AS diff FROM k a JOIN k b ON a.model < b.model")
def ev11_pairwise(s, d):
    k = _calls(s, d).groupBy("model").agg(F.avg((F.col("y") == F.col("yh")).cast("int")).alias("acc"))
    a, b = k.withColumnsRenamed({"model": "a", "acc": "x"}), k.withColumnsRenamed({"model": "b", "acc": "y"})
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(F.col("x") - F.col("y"), 6).alias("diff"))


@PLANS(f"WITH {_S}, r AS (SELECT model, y, row_number() OVER w AS k, sum(CAST(y AS INT)) OVER w AS h FROM q WINDOW w AS (PARTITION BY model ORDER BY pr DESC, sentence_id)), m AS (SELECT model, coalesce(avg(h / k) FILTER (y), 0) AS ap, coalesce(1.0 / min(k) FILTER (y), 0) AS rr, count(*) FILTER (y AND k <= 1) / 1.0 AS p1, count(*) FILTER (y AND k <= 5) / 5.0 AS p5, count(*) FILTER (y AND k <= 10) / 10.0 AS p10, count(*) FILTER (y AND k <= 20) / 20.0 AS p20, count(*) FILTER (y AND k <= 30) / 30.0 AS p30 FROM r GROUP BY 1) SELECT round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr, round(avg(p1), 6) AS p_at_1, round(avg(p5), 6) AS p_at_5, round(avg(p10), 6) AS p_at_10, round(avg(p20), 6) AS p_at_20, round(avg(p30), 6) AS p_at_30 FROM m")
def ev12_ranking(s, d):
    """EV12, WN21."""
    return E.ranking_metrics(_calls(s, d), "model", "pr", "y", "sentence_id")


@PLANS("WITH t AS (SELECT sentence_id, module, unnest(from_json(logprobs, '[{\"token\":\"VARCHAR\",\"logprob\":\"DOUBLE\"}]'), recursive := true) FROM (SELECT DISTINCT sentence_id, module, logprobs FROM raw_responses WHERE logprobs IS NOT NULL AND json_valid(logprobs))), m AS (SELECT module, token, avg(greatest(logprob, -100)) AS m FROM t GROUP BY 1, 2), v AS (SELECT DISTINCT token FROM m), g AS (SELECT v.token, coalesce(a.m, -100) AS a, coalesce(b.m, -100) AS b FROM v LEFT JOIN (SELECT * FROM m WHERE module = 'checkability') a USING (token) LEFT JOIN (SELECT * FROM m WHERE module = 'verifiability') b ON b.token = v.token) SELECT count(*) AS tokens, round(avg(abs(a - b)), 5) AS drift FROM g")
def ev13_drift(s, d):
    r = table(s, d, "raw_responses").where("logprobs is not null").select("sentence_id", "module", "logprobs").distinct()
    t = r.select("module", F.inline(F.from_json("logprobs", "array<struct<token string, logprob double>>")))
    m = t.groupBy("module", "token").agg(F.avg(F.greatest("logprob", F.lit(-100.0))).alias("m"))
    g = m.groupBy("token").agg(F.coalesce(F.max(F.when(F.col("module") == "checkability", F.col("m"))), F.lit(-100.0)).alias("a"), F.coalesce(F.max(F.when(F.col("module") == "verifiability", F.col("m"))), F.lit(-100.0)).alias("b"))
    return g.agg(F.count("*").alias("tokens"), F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 5).alias("drift"))


@PLANS("WITH v AS (SELECT length(text) AS x, split = 'dev' AS side FROM (SELECT DISTINCT sentence_id, text, split FROM normalizations) WHERE split IN ('dev', 'test')), c AS (SELECT x, count(*) FILTER (side) AS a, count(*) FILTER (NOT side) AS b FROM v GROUP BY 1), r AS (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c WINDOW w AS (ORDER BY x)) SELECT round(max(abs(ca / na - cb / nb)), 6) AS ks FROM r")
def ev14_ks(s, d):
    n = table(s, d, "normalizations").where("split in ('dev', 'test')").select("sentence_id", "text", "split").distinct().select(F.length("text").alias("x"), (F.col("split") == "dev").alias("side"))
    return E.ks_statistic(n, "x", "side")


@PLANS(f"WITH {_P}, e AS (SELECT p.*, length(t.text) AS n FROM p JOIN (SELECT sentence_id, min(text) AS text FROM predictions GROUP BY 1) t USING (sentence_id)) SELECT CASE WHEN y AND NOT yh THEN 'fn' WHEN NOT y AND yh THEN 'fp' ELSE 'ok' END AS kind, count(*) AS n, round(avg(n), 4) AS mean_chars FROM e GROUP BY 1")
def ev16_error_slices(s, d):
    t = table(s, d, "predictions").groupBy("sentence_id").agg(F.min("text").alias("text"))
    kind = F.when(F.col("y") & ~F.col("yh"), "fn").when(~F.col("y") & F.col("yh"), "fp").otherwise("ok")
    return _calls(s, d).join(t, "sentence_id").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"))


_E = _S + ", w AS (SELECT sentence_id, max(pr) FILTER (model = 'orla-7b-instruct') AS a, max(pr) FILTER (model = 'quarz-large') AS b, max(pr) FILTER (model = 'deb-base') AS c FROM q GROUP BY 1 HAVING a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL)"


def _wide(s, d):
    names = {"orla-7b-instruct": "a", "quarz-large": "b", "deb-base": "c"}
    w = _calls(s, d).groupBy("sentence_id").pivot("model", list(names)).agg(F.max("pr")).withColumnsRenamed(names)
    return w.dropna()


@PLANS(f"""WITH {_E} SELECT sentence_id, round((a + b + c) / 3, 6) AS soft, round(a + b + c - greatest(a, b, c) - least(a, b, c), 6) AS median, round(exp((ln(greatest(a, 1e-10)) + ln(greatest(b, 1e-10)) + ln(greatest(c, 1e-10))) / 3), 6) AS geometric, CASE WHEN CAST(a >= 0.5 AS INT) + CAST(b >= 0.5 AS INT) + CAST(c >= 0.5 AS INT) >= 2 THEN 1.0 ELSE 0.0 END AS hard,
round(greatest(abs(a - 0.5), abs(b - 0.5), abs(c - 0.5)), 6) AS surest FROM w""")
def ud10_ensembles(s, d):
    x = E.combined(["a", "b", "c"])
    return _wide(s, d).select("sentence_id", *[F.round(x[k], 6).alias(k) for k in ("soft", "median", "geometric")], x["hard"].alias("hard"), F.round(F.abs(x["confident"] - 0.5), 6).alias("surest"))


@PLANS(f"WITH {_E}, t AS (SELECT sentence_id, list_transform([a, b, c], lambda x: 1 / (1 + exp(-ln(least(greatest(x, 1e-8), 1 - 1e-8) / (1 - least(greatest(x, 1e-8), 1 - 1e-8))) / 0.5))) AS t, a, b FROM w) SELECT sentence_id, round((t[1] + t[2] + t[3]) / 3, 6) AS tempered, round(0.6 * a + 0.4 * b, 6) AS fused, 0.6 * a + 0.4 * b >= 0.5 AS call FROM t")
def ma07_tempered_fusion(s, d):
    """MA07, MA11, MA12."""
    w = _wide(s, d)
    t = M.mean_of(*[M.tempered(F.col(c), 0.5) for c in "abc"])
    fused = 0.6 * F.col("a") + 0.4 * F.col("b")
    return w.select("sentence_id", F.round(t, 6).alias("tempered"), F.round(fused, 6).alias("fused"), (fused >= 0.5).alias("call"))


@PLANS(f"WITH {_E}, l AS (SELECT *, (a + b + c) / 3 AS m FROM w) SELECT sentence_id, round(ln(least(greatest(a, 1e-6), 1 - 1e-6) / (1 - least(greatest(a, 1e-6), 1 - 1e-6))), 6) AS logit_a, round(((a - m) * (a - m) + (b - m) * (b - m) + (c - m) * (c - m)) / 3, 6) AS variance, round(greatest(a, b, c) - least(a, b, c), 6) AS spread, CAST(a >= 0.5 AS INT) + CAST(b >= 0.5 AS INT) + CAST(c >= 0.5 AS INT) AS votes, (a >= 0.5) = (b >= 0.5) AND (b >= 0.5) = (c >= 0.5) AS unanimous FROM l")
def ma08_cross_features(s, d):
    """MA08, MA10."""
    yes = lambda c: F.col(c) >= 0.5
    return _wide(s, d).select(
        "sentence_id", F.round(M.logit(F.col("a")), 6).alias("logit_a"), F.round(M.variance_of(F.col("a"), F.col("b"), F.col("c")), 6).alias("variance"), F.round(F.greatest("a", "b", "c") - F.least("a", "b", "c"), 6).alias("spread"), (yes("a").cast("int") + yes("b").cast("int") + yes("c").cast("int")).alias("votes"), ((yes("a") == yes("b")) & (yes("b") == yes("c"))).alias("unanimous")
    )


@PLANS(f"WITH {_S}, w AS (SELECT model, sentence_id, rank() OVER (PARTITION BY model ORDER BY pr) AS r, count(*) OVER (PARTITION BY model, pr) AS ties, count(*) OVER (PARTITION BY model) AS n FROM q) SELECT sentence_id, round(avg((r + (ties - 1) / 2.0) / n), 6) AS rank_mean FROM w GROUP BY 1")
def ud10_rank_average(s, d):
    from tideline.operators.ranking import average_rank_by_counts

    return average_rank_by_counts(_calls(s, d), "pr", "r", "model").groupBy("sentence_id").agg(F.round(F.avg("r"), 6).alias("rank_mean"))




@PLANS("WITH p AS (SELECT model, split, sentence_id, max(lower(true_label)) = 'yes' AS y, max(lower(predicted_label)) = 'yes' AS h FROM predictions WHERE true_label IS NOT NULL AND predicted_label IS NOT NULL GROUP BY 1, 2, 3), r AS (SELECT model, split, count(*) FILTER (y = h) / count(*) AS acc, CASE WHEN count(*) FILTER (y) + count(*) FILTER (h) = 0 THEN 0 ELSE 2 * count(*) FILTER (y AND h) / (count(*) FILTER (y) + count(*) FILTER (h)) END AS f1 FROM p GROUP BY 1, 2) SELECT model, count(*) AS runs, round(avg(acc), 6) AS accuracy, round(coalesce(stddev_samp(acc), 0), 6) AS accuracy_std, round(avg(f1), 6) AS f1, round(coalesce(stddev_samp(f1), 0), 6) AS f1_std FROM r GROUP BY model")
def ev15_across_runs(s, d):
    """EV15: metrics of every run of a model (here its splits), then their mean and sample deviation across runs."""
    p = table(s, d, "predictions").where("true_label is not null and predicted_label is not null")
    one = p.groupBy("model", "split", "sentence_id").agg((F.max(F.lower("true_label")) == "yes").alias("y"), (F.max(F.lower("predicted_label")) == "yes").alias("h"))
    y, h = F.col("y"), F.col("h")
    both = F.count_if(y) + F.count_if(h)
    runs = one.groupBy("model", "split").agg((F.count_if(y == h) / F.count("*")).alias("acc"), F.when(both == 0, 0.0).otherwise(2 * F.count_if(y & h) / F.nullif(both, F.lit(0))).alias("f1"))
    dev = lambda c: F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 6)
    return runs.groupBy("model").agg(F.count("*").alias("runs"), F.round(F.avg("acc"), 6).alias("accuracy"), dev("acc").alias("accuracy_std"), F.round(F.avg("f1"), 6).alias("f1"), dev("f1").alias("f1_std"))
