"""Operators against brute force, and their defined results for nulls, empties, repeats, ties, long texts and extra columns."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import p1_splits, p2_unify, p3_pii, p4_edits, p5_pairs, p6_topn, p7_history, p8_pack, p9_leaks, p10_split
from tideline.llm.fmindex import WordIndex, extend
from tideline.llm.sketch import banded_distance, occurrence_labels
from tideline.llm.textforms import words
from tideline.llm.tokens import tokens
from tideline.llm.wordsets import key_filter, may_have, word_rows
from tideline.operators.staging import stage

VOCABULARY = [a + b for a in "ba de fi go lu me na po ra su ti vo".split() for b in "lan mor nis pel rut sav tek wom".split()]


def text(rng, n=14):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(rng, t, edits=1):
    w = t.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
    return " ".join(w)


def similarity(a, b):
    x, y = set(words(a)), set(words(b))
    return len(x & y) / len(x | y) if min(len(x), len(y)) >= 8 else 0


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = text(rng)
        rows += [(f"a{i:03d}", t), (f"b{i:03d}", edited(rng, t)), (f"c{i:03d}", t.upper() + " !")]
    rows += [("short", "only four words here"), ("empty", ""), ("null", None), (None, text(rng)), ("a000", rows[0][1]), ("long", text(rng, 5000))]
    return rows


def test_p4_finds_what_brute_force_finds(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id string, body string").withColumn("key", F.lit(1)).withColumn("cls", F.lit("clash")).repartition(3)
    got = {(r.key_a, r.key_b) for r in p4_edits.pairs_of_keys(*p4_edits.near_duplicates(df, "id", "body")).collect()}
    one = {k: t for k, t in rows if k and t}
    truth = {(a, b) for a, b in itertools.combinations(sorted(one), 2) if similarity(one[a], one[b]) >= 0.7}
    assert got == truth and len(truth) > 100
    empty = df.where("false")
    assert p4_edits.pairs_of_keys(*p4_edits.near_duplicates(empty, "id", "body")).count() == 0
    g = {r["key"]: r for r in p4_edits.groups(df, "id", "body").collect()}
    assert g["a000"].copies == 2 and g["a000"].links >= 1


def test_p4_candidates_of_hot_samples(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(40), rng.randrange(500)) for _ in range(800)] + [(7, i) for i in range(120)]
    df = spark.createDataFrame(rows, "sample long, cls long").repartition(4)
    by = {}
    for s, c in rows:
        by.setdefault(s, set()).add(c)
    truth = {p for v in by.values() for p in itertools.combinations(sorted(v), 2)}
    for hot in (2, 30, 10_000):
        assert {tuple(r) for r in p4_edits.candidates(df, hot).collect()} == truth


def test_p4_hot_samples_are_cut_into_blocks(spark):
    """20,000 classes under one sample: no join key has many more rows than a block, and no pair is lost."""
    left = stage(spark.range(20_000).select(F.lit(5).cast("long").alias("sample"), F.col("id").alias("a"), (F.col("id") % 97).alias("ca")).union(spark.range(40).select((F.col("id") + 100).alias("sample"), "id", "id")), "hot")
    right = left.withColumnsRenamed({"a": "b", "ca": "cb"})
    joined = p4_edits.split_join(left, right).where("a < b and ca = cb")
    n = [20_000 // 97 + (k < 20_000 % 97) for k in range(97)]
    one = sum(k * (k - 1) // 2 for k in n)
    assert joined.where("sample = 5").count() == one and joined.where("sample >= 100").count() == 0
    blocks = -(-20_000 // p4_edits.HOT_BLOCK)
    per = left.where("sample = 5").groupBy(F.pmod(F.xxhash64("a"), F.lit(blocks)).alias("k")).count().agg(F.max("count")).first()[0]
    assert blocks >= 19 and per < 1.3 * p4_edits.HOT_BLOCK


def test_p4_components(spark):
    rng = random.Random(31)
    edges = [(i, i + 1) for i in range(0, 70)] + [(100 + i, 100) for i in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    edges = [(a, b) for a, b in edges if a != b]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    got = {r["cls"]: r.component for r in p4_edits.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in root}
    assert p4_edits.components(spark.createDataFrame([], "a long, b long")).count() == 0


def copies_in_a_crowd(copies=80, others=160):
    """Copies of one text with a rare word each, a third of all rows; the others share no word."""
    rng = random.Random(23)
    base = [f"shared{j}" for j in range(14)]
    rows = []
    for i in range(copies):
        w = list(base)
        w[rng.randrange(14)] = f"slip{i}"
        rows.append((f"c{i:03d}", " ".join(w)))
    return rows + [(f"o{i:03d}", " ".join(f"other{i}x{j}" for j in range(14))) for i in range(others)]


def test_p4_and_p7_find_copies_that_hold_a_third_of_all_rows(spark):
    rows = copies_in_a_crowd()
    truth = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if similarity(x, y) >= 0.7}
    assert len(truth) == 80 * 79 // 2
    df = spark.createDataFrame(rows, "id string, body string")
    got = {(r.key_a, r.key_b) for r in p4_edits.pairs_of_keys(*p4_edits.near_duplicates(df, "id", "body")).collect()}
    assert got <= truth and len(got) >= 0.98 * len(truth)
    incoming, history = (stage(word_rows(df.where(w), "id", "body"), "rows") for w in ("id < 'c040'", "id >= 'c040'"))
    outer, _ = p7_history.pairs_within(incoming, history, 0.7)
    assert outer.count() >= 0.98 * 40 * 40


def test_banded_distance_equals_the_full_table():
    rng = random.Random(5)

    def full(x, y):
        p = list(range(len(y) + 1))
        for i, c in enumerate(x):
            q = [i + 1]
            for j, e in enumerate(y):
                q.append(min(p[j] + (c != e), p[j + 1] + 1, q[j] + 1))
            p = q
        return p[-1]

    a = [np.array([rng.randrange(4) for _ in range(rng.randrange(0, 12))]) for _ in range(200)]
    b = [np.array([rng.randrange(4) for _ in range(rng.randrange(0, 12))]) for _ in range(200)]
    got = banded_distance(a, b, 4)
    assert [d if (d := full(x.tolist(), y.tolist())) <= 4 else -1 for x, y in zip(a, b)] == got.tolist()


def test_occurrence_labels():
    assert occurrence_labels(np.array([5, 5, 7, 5, 5], np.uint32), np.array([0, 4, 5])).tolist() == [0, 1, 0, 2, 0]


def test_key_filter_has_no_false_negative(spark):
    keys = spark.range(0, 5000).select((F.col("id") * 7919).alias("k")).repartition(3)
    bitmap = key_filter(keys, "k")
    assert may_have(bitmap, np.arange(0, 5000, dtype=np.int64) * 7919).all()
    assert may_have(bitmap, np.arange(1, 100_001, dtype=np.int64) * -31).mean() < 0.1
    assert not may_have(key_filter(keys.where("false"), "k"), np.arange(10, dtype=np.int64)).any()


def test_word_index_equals_scanning():
    rng = random.Random(2)
    texts = [np.array([rng.randrange(1, 9) for _ in range(rng.randrange(1, 12))], np.int64) for _ in range(25)]
    index = WordIndex(texts, rate=3)
    pats = [np.array([rng.randrange(1, 10) for _ in range(rng.randrange(1, 8))], np.int64) for _ in range(20)]
    off = np.concatenate([[0], np.cumsum([len(p) for p in pats])])
    row = np.repeat(np.arange(20), np.diff(off))
    flat = np.concatenate(pats)
    low, high = index.search(index.codes(flat), np.zeros(len(flat), np.int64), np.full(len(flat), index.n, np.int64))
    which, where, at = index.locate(low, high)
    for e in range(off[-1]):
        hits = [(i, j) for i, x in enumerate(texts) for j in range(len(x)) if x[j] == flat[e]]
        assert sorted(zip(where[which == e].tolist(), at[which == e].tolist())) == hits
    two = np.flatnonzero(row[1:] == row[:-1]) + 1  # a second step to the left: pairs of words
    lo, hi = index.search(index.codes(flat[two - 1]), low[two], high[two])
    for k, e in enumerate(two):
        assert hi[k] - lo[k] == sum(x[j] == flat[e - 1] and x[j + 1] == flat[e] for x in texts for j in range(len(x) - 1))
    b = np.concatenate(texts)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    i = row[which]
    first, last = extend(flat, off[i], off[i + 1], b, starts[where], starts[where + 1], which, starts[where] + at)
    for n in range(len(which)):
        p, x, u, v = pats[i[n]], texts[where[n]], which[n] - off[i[n]], at[n]
        s = e = 0
        while u - s > 0 and v - s > 0 and p[u - s - 1] == x[v - s - 1]:
            s += 1
        while u + e + 1 < len(p) and v + e + 1 < len(x) and p[u + e + 1] == x[v + e + 1]:
            e += 1
        assert (first[n] - off[i[n]], last[n] - off[i[n]]) == (u - s, u + e + 1)


def test_p1_finds_what_brute_force_finds(spark):
    rng = random.Random(9)
    rows = []
    for i in range(50):
        t = text(rng)
        rows += [(f"t{i}", t, "train", None), (f"d{i}", edited(rng, t), "dev", "s"), (f"e{i}", text(rng), "test", None)]
    rows += [("x", None, "dev", None), (None, rows[0][1], "dev", None), ("y", rows[0][1], None, None), ("z", "", "test", None), ("t0", rows[0][1], "train", None), ("t1", rows[3][1], "test", None)]
    df = spark.createDataFrame(rows, "sentence_id string, text string, split string, source string").withColumn("label", F.lit("Yes")).withColumn("shard", F.lit(0))
    got = {tuple(r) for r in p1_splits.found(df).collect()}
    train = [(k, t) for k, t, s, _ in rows if k and t and s == "train"]
    held = [(k, t) for k, t, s, _ in rows if k and t and s and s != "train"]
    truth = {(min(a, b), max(a, b)) for a, x in train for b, y in held if a != b and similarity(x, y) >= 0.8}
    assert got == truth and len(truth) > 30
    pred = spark.createDataFrame([("d1", "YES"), ("d2", "no"), ("d3", None)], "sentence_id string, true_label string")
    r = {(x.split, x.source): x for x in p1_splits.report(df, pred).collect()}
    assert r["dev", "s"].label_agrees == 1 and r["dev", "s"].label_differs == 1
    assert p1_splits.found(df.where("false")).count() == 0


def test_p2(spark):
    rows = [("1", "wоrd one"), ("2", "word one"), ("3", None), (None, "re​port"), ("4", "re​port"), ("4", "re​port"), ("5", ""), ("6", "ａ" * 20000)]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("form", F.lit(0)).withColumn("changed", F.lit(0))
    assert sorted(r.id for r in p2_unify.inconsistent(df, "id", "text").collect()) == ["1", "4", "6"]
    s = p2_unify.spellings(df, "id", "text").collect()
    assert [(r.texts, r.spellings, r.form) for r in s] == [(2, 2, "word one")]
    assert p2_unify.inconsistent(df.where("false"), "id", "text").count() == 0


def test_p3(spark):
    given = frozenset({"olga", "nils"})
    rows = [("1", "Ask Olga Tamby about it. Signed by OLGA TAMBY; tel (415) 555-0119; mail a@b.example"), ("2", None), ("3", ""), ("4", "nothing here"), ("1", "Ask Olga Tamby about it."), ("5", "signed by Nils Tamby;")]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("piece", F.lit(1)).withColumn("key", F.lit(1))
    assert sorted(tuple(r) for r in p3_pii.found(df, "id", "text", "tweets", given).collect()) == [("tweets", "1", "email"), ("tweets", "1", "name"), ("tweets", "1", "phone"), ("tweets", "5", "name")]
    out = {(r.rec_id, r.redacted): r.surrogate for r in p3_pii.replaced([("t", df, "id", "text")], given, "s").collect()}
    red = next(k for k in out if k[0] == "1" and "phone" in k[1])
    assert red[1] == "Ask [name] about it. Signed by [name]; tel [phone]; mail [email]"
    sur = out[red]
    who = sur.split("Ask ")[1].split(" about")[0]
    assert who.upper() in sur and "Olga" not in sur and "(415) 555-0119" not in sur and out["4", "nothing here"] == "nothing here"
    assert p3_pii.found(df.where("false"), "id", "text", "t", given).count() == 0


def test_p3_surrogates_stay_distinct(spark):
    given = frozenset({"olga"})
    who = [(str(i), f"signed by Olga {a}{b};") for i, (a, b) in enumerate(itertools.product(["Tam", "Sol", "Ver", "Kin"], ["by", "sen", "ini", "worth"]))]
    out = [r.surrogate for r in p3_pii.replaced([("t", spark.createDataFrame(who, "id string, text string"), "id", "text")], given, "s").collect()]
    assert len(set(out)) == len(out)


def test_p3_addresses_keep_only_the_type_of_street(spark):
    texts = ["We met at Calle Glianreisby 175.", "We met at 12 Oak St.", "We met at Lindenstraße 12."]
    numbers = [f"We met at {i} Oak St." for i in range(10, 100)] + [f"passport {i:07d}, " for i in range(1000, 1300)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts + numbers)], "id string, text string")
    out = {int(r.rec_id): r.surrogate for r in p3_pii.replaced([("t", df, "id", "text")], frozenset(), "s").collect()}
    assert "Calle " in out[0] and "Glianreisby" not in out[0] and " St." in out[1] and "Oak" not in out[1] and "straße" in out[2] and "Linden" not in out[2]
    assert len({out[i] for i in range(3, len(out))}) == len(numbers)


def test_p3_nothing_of_a_name_or_street_survives(spark, folder):
    """Over all tweets and posts: no word of three letters of a detected name or street stands in its surrogate, but types of streets."""
    t, p = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("tweets", "posts"))
    given = p3_pii.given_names(spark.read.parquet(f"{folder}/name_list.parquet"))
    pieces = p3_pii.pieces(t, "tweet_id", "text", given).unionByName(p3_pii.pieces(p, "idx", "post", given)).collect()
    more = [("name", "Иван Петров"), ("name", "Ольга Петрова"), ("name", "Beatriz Lopera"), ("name", "李明"), ("address", "улица Ленина 5"), ("address", "7 Oak Ave"), ("address", "12 Elm St, Boston"), ("address", "Calle Mayor 3")]
    mac, names = p3_pii.key_of("a secret"), tuple(sorted(given))
    for kind, piece, who in [(r.pii_type, r.piece, r.entity) for r in pieces] + [(k, x, p3_pii.entity(k, x)) for k, x in more]:
        if kind in ("name", "address"):
            made = p3_pii.surrogate(kind, piece, who, mac, 0, names)
            true = {w for w in words(piece) if len(w) >= 3 and not w.isdigit()} - (p3_pii._ADDRESS_KEPT if kind == "address" else set())
            assert true.isdisjoint(words(made)), (piece, made)
            assert [p3_pii.script(c) for c in piece if c.isalpha()][0] == [p3_pii.script(c) for c in made if c.isalpha()][0], (piece, made)
    assert p3_pii.surrogate("name", "Иван Петров", "иван петров", p3_pii.key_of("other"), 0, names) != p3_pii.surrogate("name", "Иван Петров", "иван петров", mac, 0, names)
    with pytest.raises(ValueError):
        p3_pii.key_of("")


def test_p3_entities_are_one_over_all_tables_and_never_real(spark):
    a = spark.createDataFrame([(str(i), f"passport {i:05d}, ") for i in range(3000, 6000)], "id string, text string")
    b = spark.createDataFrame([("x", "passport 03001, "), ("y", "passport 07777, ")], "id string, body string")
    out = p3_pii.replaced([("a", a, "id", "text"), ("b", b, "id", "body")], frozenset(), "s").collect()
    made = {(r.src, r.rec_id): r.surrogate.removeprefix("passport ").strip(" ,") for r in out}
    assert made["a", "3001"] == made["b", "x"] and len(set(made.values())) == 3001
    assert not set(made.values()) & {f"{i:05d}" for i in [*range(3000, 6000), 7777]}


def test_p3_names_in_sentences_unlike_any_seen():
    """Names that no list has, in frames of other words than the test tables use."""
    from tideline.llm.pii_detect import find

    for frame in ("Yesterday I met {} at the fair.", "Her colleague {} was late again.", "We spoke with {} for an hour.", "Then {} phoned us from the station.", "{} lives in the house behind ours.", "The parcel was signed by {} at noon.", "I'm {} and I saw the accident.", "Mi vecina {} tiene la llave.", "Hier {} m'a dit la vérité.", "Gestern hat {} uns geholfen, mein Nachbar {} auch."):
        for name in ("Ysolde Brimpham", "Tomasz Wieczorek", "Ngozi Adeyemi", "Ana-Lucía Fuentes"):
            text_ = frame.replace("{}", name)
            got = [text_[s:e] for k, s, e in find(text_) if k == "name"]
            assert name in got, (text_, got)


def test_p5(spark):
    ask = '[{"role": "user", "content": "Claim: The banks of Xora lost 5 million files in June."}]'
    raw = [("1", "m", ask, '{"reasoning": "The report names the banks and it is on file."}', None), ("2", "m", ask, None, "timed out"), ("3", "m", ask, '{"reasoning": "The report na', None), ("4", "m", ask, '{"reasoning": "I am unable to help with this request."}', None), ("5", "m", ask, '{"reasoning": "The banks of Xora lost 5 million files in June"}', None), ("6", "m", ask, '{"reasoning": "Les banques de la ville ont perdu des dossiers et les maires sont dans le doute."}', None), (None, "m", ask, None, None), ("1", "m", ask, '{"reasoning": "The report names the banks and it is on file."}', None), ("7", "m", None, "not json at all but words.", None)]
    r = spark.createDataFrame(raw, "sentence_id string, module string, prompt_messages string, response_json string, error string").withColumn("answer", F.lit(1))
    norm = [("1", "n", "A text of some words stands here.", "A claim of some words stands.", True, None), ("2", "n", "A text of some words stands here.", None, False, None), ("3", "n", "A text of some words stands here.", None, True, "Parse failed: Sorry, I can't restate this post."), ("4", "n", "A text.", "N/A", True, None), ("5", "n", None, "It stands.", True, None)]
    n = spark.createDataFrame(norm, "sentence_id string, model_name string, text string, normalized_claim string, has_claim boolean, error string")
    got = {(x.src[:3], x.sentence_id): x.defect for x in p5_pairs.found(r, n).collect()}
    assert got == {("raw", "2"): "empty", ("raw", "3"): "truncated", ("raw", "4"): "refusal", ("raw", "5"): "copy", ("raw", "6"): "other_language", ("nor", "3"): "refusal", ("nor", "4"): "empty"}
    assert p5_pairs.found(r.where("false"), n.where("false")).count() == 0
    told = {(x.src, x.defect): (x.answers, x.most_copied) for x in p5_pairs.report(r, n).groupBy("src", "defect").agg(F.sum("answers").alias("answers"), F.max("most_copied").alias("most_copied")).collect()}
    assert told["raw_responses", "copy"] == (1, 1.0) and told["raw_responses", "none"][0] == 2 and told["normalizations", "none"][1] > 0.5
    assert p5_pairs.report(r.where("false"), n.where("false")).count() == 0


def test_p5_refusals_of_any_length():
    claim = "The banks of Xora lost five million files in June and nobody answered. " * 12
    assert p5_pairs.is_refusal(f"I'm sorry, but I can't help with this request. The claim was: “{claim}”")
    assert p5_pairs.is_refusal(f"As an AI I take no side on “{claim}” and leave it there.")
    assert p5_pairs.is_refusal(f"I'm unable to help with this request. {claim} {claim} {claim}")  # over 2,000 characters
    assert p5_pairs.is_refusal(f"{claim} I have thought about it for long. For these reasons I must decline to assess it.")
    assert not p5_pairs.is_refusal(f"{claim} They said “sorry, we are unable to assist”. {claim}")


def test_p5_truncation_of_short_answers():
    given = "Crime near banks dropped 5% once Xora hired twelve dockers in the harbour district."
    assert p5_pairs.goes_on_in("Crime near ban", given) and p5_pairs.goes_on_in("hired twelve dockers in the", given)
    assert not p5_pairs.goes_on_in("Crime", given) and not p5_pairs.goes_on_in("in the harbour district", given) and not p5_pairs.goes_on_in("rime near", given)


def test_p5_coverage():
    given = "crime near banks dropped once xora hired twelve dockers"
    assert p5_pairs.copied_share("they say crime near banks dropped for long", given) == (0.5, False)
    assert p5_pairs.copied_share(given + " we say so", given) == (0.75, True)
    assert p5_pairs.copied_share("xora hired twelve dockers once crime near banks dropped", given)[1] is False  # all its words, not in order


def test_p6(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 2, 2, 2, 2, 2, 3]), f"k{rng.randrange(4000):05d}", rng.randrange(60) / 60) for _ in range(6000)]
    rows += [(9, "only", 0.5), (None, "n", 0.9), (-1, "n", 0.9), (4, "n", None), (4, "n", float("nan")), (4, None, 0.3), rows[0], (5, "b", 0.7), (5, "a", 0.7)]
    df = spark.createDataFrame(rows, "cluster int, id string, sim double").withColumn("item", F.lit(1)).withColumn("g", F.lit(2))
    got = [(r.g, r["item"], r.place) for r in p6_topn.top_n(df, "cluster", "id", "sim", 5).collect()]
    best = {}
    for c, k, s in rows:
        if c is not None and c >= 0 and k is not None and s is not None and s == s:
            best.setdefault(c, {})[k] = max(s, best.get(c, {}).get(k, -1))
    truth = [(c, k, i + 1) for c, v in best.items() for i, (k, _) in enumerate(sorted(v.items(), key=lambda x: (-x[1], x[0]))[:5])]
    assert sorted(got) == sorted(truth)
    assert p6_topn.top_n(df.where("false"), "cluster", "id", "sim").count() == 0


def test_p6_skips_row_groups(spark):
    df = spark.range(0, 60_000).select(F.lit(1).alias("g0"), F.col("id").cast("string").alias("id"), (F.hash("id") % 100_000 / 1e5).alias("s"))
    layout = p6_topn.clustered(df.coalesce(1), "g0", "id", "s", 16 * 1024)
    m = p6_topn.manifest(layout).toPandas()
    _, read = p6_topn.read_skipping(m, 5)
    assert len(m) >= 8 and read <= 2


def test_p6_skips_row_groups_of_many_groups(spark, tmp_path):
    """10,000 groups of 40 items: most row groups hold hundreds of groups and are skipped once each of these has its five."""
    df = spark.range(0, 400_000).select((F.col("id") % 10_000).alias("g0"), F.col("id").cast("string").alias("id"), (F.hash("id") % 1_000_000 / 1e6).alias("s"))
    layout = p6_topn.clustered(df, "g0", "id", "s", 8 * 1024, str(tmp_path / "layout"))
    m = p6_topn.manifest(layout).toPandas()
    assert (m.g_low < m.g_high).mean() > 0.9
    read = sum(p6_topn.read_skipping(x, 5)[1] for _, x in m.groupby("path"))
    assert read < 0.5 * len(m)
    again = p6_topn.layout_at(spark, str(tmp_path / "layout"))  # read by a later call
    got = {(r.g, r["item"]) for r in p6_topn.top_of(again).collect()}
    best = df.groupBy("g0").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "id"))), 1, 5).alias("x")).select("g0", F.explode("x.id").alias("id"))
    assert got == {(r.g0, r.id) for r in best.collect()}


def test_p7_follows_the_order(spark):
    rng = random.Random(7)
    hist = [(f"h{i}", text(rng)) for i in range(40)] + [("hn", None)]
    inc = []
    for i in range(60):
        src = rng.choice([hist[i % 40][1], text(rng), inc[-1][2] if inc and inc[-1][2] else text(rng)])
        inc.append((rng.randrange(1, 5), f"i{i:02d}", edited(rng, src) if rng.random() < 0.6 else src))
    inc += [(2, "i00", inc[0][2]), (1, "nul", None), (1, None, text(rng)), (1, "sho", "too short"), (9, "i03", text(rng))]
    h = spark.createDataFrame(hist, "id string, body string").withColumn("cls", F.lit(1))
    n = spark.createDataFrame(inc, "batch int, id string, body string").withColumn("key", F.lit(0))
    got = {r["key"] for r in p7_history.known_in(n, "id", "batch", "body", [(h, "id", "body")]).collect()}
    first = {}
    for b, k, t in inc:
        if k is not None and (k not in first or b < first[k][0]):
            first[k] = (b, t)
    accepted, known = [t for _, t in hist if t], set()
    for k, (b, t) in sorted(first.items(), key=lambda x: (x[1][0], x[0])):
        if t and len(set(words(t))) >= 8:
            if any(similarity(t, a) >= 0.7 for a in accepted):
                known.add(k)
            else:
                accepted.append(t)
    assert got == known and len(known) > 10
    assert p7_history.known_in(n.where("false"), "id", "batch", "body", [(h, "id", "body")]).count() == 0
    alone = {r["key"] for r in p7_history.known_in(n, "id", "batch", "body", [(h.where("false"), "id", "body")]).collect()}
    assert alone < {k for k in first}


def test_p7_batch_by_batch_equals_all_at_once(spark, tmp_path):
    rng = random.Random(17)
    hist = [(f"h{i}", text(rng)) for i in range(20)]
    inc = []
    for i in range(36):
        src = rng.choice([hist[i % 20][1], text(rng), inc[-1][2] if inc else text(rng)])
        inc.append((i // 12, f"i{i:02d}", edited(rng, src)))
    h, n = spark.createDataFrame(hist, "id string, body string"), spark.createDataFrame(inc, "batch int, id string, body string")
    at_once = {r["key"] for r in p7_history.known_in(n, "id", "batch", "body", [(h, "id", "body")]).collect()}
    store = p7_history.PivotTable(spark, f"{tmp_path}/pivots")
    store.append(h, "id", "body")
    apart = set()
    for b in range(3):
        apart |= {r["key"] for r in store.admit(n.where(F.col("batch") == b), "id", "batch", "body").collect()}
    assert apart == at_once and len(at_once) > 5
    assert store.values().select("cls").distinct().count() == 20 + 36 - len(at_once)


def test_p7_a_batch_reads_only_what_it_touches(spark, tmp_path):
    """The folders that a small batch reads are those of its own keys, however long the history is."""
    rng = random.Random(18)
    store = p7_history.PivotTable(spark, f"{tmp_path}/pivots")
    store.append(spark.createDataFrame([(f"h{i}", text(rng)) for i in range(400)], "id string, body string"), "id", "body")
    batch = spark.createDataFrame([("n0", text(rng))], "id string, body string")
    points = p7_history.points_of(stage(word_rows(batch, "id", "body"), "rows"))
    read = store._touched(store.points(), points, "sample")
    whole, touched = store.points().count(), read.count()
    files = len(store.points().inputFiles())
    assert files > 40 and touched < 0.7 * whole  # 36 keys fall into at most 36 of 64 folders
    assert "PartitionFilters: [bucket" in read._jdf.queryExecution().toString()


def test_p7_long_chains_end(spark):
    """Each value is near the one before only: every second is accepted, through any number of rounds."""
    stages = 60
    inc = [(1, f"i{i:03d}", " ".join(f"w{j}" for j in range(2 * i, 2 * i + 20))) for i in range(stages)]
    n = spark.createDataFrame(inc, "batch int, id string, body string")
    got = {r["key"] for r in p7_history.known_in(n, "id", "batch", "body", [(n.where("false"), "id", "body")]).collect()}
    assert got == {f"i{i:03d}" for i in range(1, stages, 2)}


def test_p8_plan_is_complete_and_tight():
    rng = np.random.default_rng(1)
    for scale in (0, 1, 5, 400):
        counts = np.zeros(101, np.int64)
        for s in rng.integers(1, 101, scale):
            counts[s] += 1
        plan = p8_pack.plan_of(counts, 100)
        used = np.zeros(101, np.int64)
        for times, content in plan:
            assert sum(s * c for s, c in content.items()) <= 100
            for s, c in content.items():
                used[s] += times * c
        assert (used == counts).all()
        least = -(-int((counts * np.arange(101)).sum()) // 100)
        assert sum(t for t, _ in plan) <= least * 1.25 + 2


def fewest(items, capacity):
    """The least number of containers, by trying all."""
    best, items = [len(items)], sorted(items, reverse=True)

    def go(i, room):
        if len(room) >= best[0]:
            return
        if i == len(items):
            best[0] = len(room)
            return
        seen = set()
        for k, r in enumerate(room):
            if r >= items[i] and r not in seen:
                seen.add(r)
                room[k] -= items[i]
                go(i + 1, room)
                room[k] += items[i]
        room.append(capacity - items[i])
        go(i + 1, room)
        room.pop()

    go(0, [])
    return best[0]


def test_p8_reduction_never_costs_a_container():
    rng = random.Random(5)
    for _ in range(150):
        c = rng.choice([10, 20, 30, 100])
        items = [rng.randrange(max(1, c // rng.choice([2, 3, 5, 8])), c + 1) if rng.random() < 0.6 else rng.randrange(1, c // 2 + 1) for _ in range(rng.randrange(3, 10))]
        counts = np.bincount(items, minlength=c + 1)
        plan, left = p8_pack.reduce_by_dominance(counts, c)
        used = sum((n * np.bincount(list(m), list(m.values()), c + 1).astype(int) for n, m in plan), np.zeros(c + 1, int))
        assert (used + left == counts).all() and all(sum(s * k for s, k in m.items()) <= c for _, m in plan)
        best = fewest(items, c)
        assert sum(n for n, _ in plan) + fewest(np.repeat(np.arange(c + 1), left).tolist(), c) == best
        assert p8_pack.least_containers(counts, c) <= best


def test_p8_packs_every_token_once(spark):
    rng = random.Random(8)
    rows = [(i, text(rng, rng.choice([3, 30, 300, 900]))) for i in range(60)] + [(100, ""), (101, None), (None, "x y"), (102, text(rng, 9000)), (5, "again the same id")]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("size", F.lit(1)).withColumn("bucket", F.lit(1))
    got = p8_pack.packed(df, "id", "text").collect()
    t = tokens()
    spans, fill = {}, {}
    for r in got:
        spans.setdefault(r["key"], []).append((r.token_from, r.token_to))
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert max(fill.values()) <= 2048 and sorted(fill) == list(range(len(fill)))
    for i, x in rows:
        if i is not None and x and i != 5:
            s = sorted(spans[i])
            assert s[0][0] == 0 and s[-1][1] == t.count(x) and all(a[1] == b[0] for a, b in zip(s, s[1:]))
            assert len(s) == -(-t.count(x) // 2048)
    assert 100 not in spans and 101 not in spans and len(spans[5]) == 2
    f = p8_pack.fill(p8_pack.packed(df, "id", "text")).collect()[0]
    assert f.containers <= f.least_containers + 1
    assert p8_pack.packed(df.where("false"), "id", "text").count() == 0


def test_p9_finds_what_brute_force_finds(spark, monkeypatch):
    rng = random.Random(10)
    items = [(i, text(rng, 20)) for i in range(12)] + [(50, "short item"), (51, None)]
    docs = []
    for d in range(40):
        parts = [text(rng, 30)]
        if d % 2:
            w = items[d % 12][1].split()
            n = rng.choice([11, 12, 15, 20])
            at = rng.randrange(0, 20 - n + 1)
            parts.append(" ".join(w[at : at + n]).upper().replace(" ", " ", 2))
        parts.append(text(rng, 10))
        docs.append((d, ". ".join(parts)))
    docs += [(90, None), (91, ""), (None, items[0][1]), (1, docs[1][1]), (92, text(rng, 20000) + " " + items[3][1])]
    D = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit(1))
    I = spark.createDataFrame(items, "item_id long, text string").withColumn("doc", F.lit(1))  # noqa: E741
    got = {tuple(r) for r in p9_leaks.found(D, I).collect()}
    grams = {}
    for i, x in items:
        w = words(x)
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    bags = [(d, words(x)) for d, x in docs if d is not None]
    truth = {(d, i) for d, w in bags for k in range(len(w) - 11) for i in grams.get(tuple(w[k : k + 12]), ())}
    assert got == truth and len(truth) > 8
    monkeypatch.setattr(p9_leaks, "BLOCK", 3)  # several blocks of the index in one pass
    assert {tuple(r) for r in p9_leaks.found(D, I).collect()} == truth
    assert p9_leaks.found(D.where("false"), I).count() == 0 and p9_leaks.found(D, I.where("false")).count() == 0


def test_p9_near_passages(spark):
    """A word changed, left out or put in amid a passage: a near leak of one edit; two changes apart leave none of twelve words."""
    rng = random.Random(12)
    item = [f"{rng.choice(VOCABULARY)}{i}" for i in range(20)]
    changed, left, put = item[:10] + ["other"] + item[11:], item[:9] + item[10:], item[:10] + ["more"] + item[10:]
    twice = item[:5] + ["one"] + item[6:12] + ["two"] + item[13:]
    around = lambda w: " ".join([text(rng, 15), *w, text(rng, 15)])
    D = spark.createDataFrame([(1, around(item)), (2, around(changed)), (3, around(left)), (4, around(put)), (5, around(twice)), (6, text(rng, 50))], "doc_id long, text string")
    I = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")  # noqa: E741
    got = {r.doc: (r.words, r.near_words, r.edits) for r in p9_leaks.leaks(D, I, edits=3).collect()}
    usual = {r.doc: (r.words, r.near_words, r.edits) for r in p9_leaks.leaks(D, I).collect()}
    assert usual == {k: v for k, v in got.items() if k != 5}  # five, six and seven words in a row share too few q-grams for an edit budget of one character
    assert got == {1: (20, 20, 0), 2: (10, 19, 1), 3: (10, 19, 1), 4: (10, 20, 1), 5: (7, 13, 1)}
    assert {tuple(r) for r in p9_leaks.found(D, I).collect()} == {(1, 7)}


@pytest.mark.parametrize("body", ["One two three. " * 900, "para one here\n\n" * 700, "x" * 30000, "据东砚消息，选票丢失。" * 600, "word " * 5000, "A: turn one\nB: turn two goes on\n" * 500])
def test_p10_pieces_round_trip(body):
    t = tokens()
    ids = t.ids(body)
    parts = p10_split.pieces_of(body, t)
    assert len(parts) > 1 and parts[0][1] == 0 and parts[-1][2] == len(ids)
    for (_, a, b, _, text_), nxt in zip(parts, [*parts[1:], None]):
        assert b - a <= 1024
        if nxt:
            assert nxt[1] == b - 64  # the overlap
    whole = "".join(t.encoding.decode_bytes(ids[(p[1] if k == 0 else p[1] + 64) : p[2]].tolist()).decode("utf-8", "ignore") for k, p in enumerate(parts))
    assert whole.replace("�", "") == body or len(whole) >= len(body) - len(parts)


def test_p10_prefers_strong_boundaries_and_edges(spark):
    body = "\n\n".join(" ".join(["word"] * 300) + "." for _ in range(8))
    t = tokens()
    assert all(s >= p10_split.PARAGRAPH for *_, s, _ in p10_split.pieces_of(body, t)[1:])
    df = spark.createDataFrame([(1, body), (2, "short"), (3, None), (4, ""), (None, body), (1, body)], "id long, text string").withColumn("piece", F.lit(1))
    got = p10_split.pieces(df, "id", "text").collect()
    assert {r["key"] for r in got} == {1} and max(r.n_tokens for r in got) <= 1024
    assert p10_split.pieces(df.where("false"), "id", "text").count() == 0


def test_p10_measures_the_consistent_form(spark):
    """No-break spaces are tokens of their own for this vocabulary; they don't make a text oversized."""
    body = "\u00a0".join(["word"] * 900)
    assert tokens().count(body) > 1024
    df = spark.createDataFrame([(1, body), (2, "\u00a0".join(["word"] * 1500))], "id long, text string")
    got = p10_split.pieces(df, "id", "text").collect()
    assert {r["key"] for r in got} == {2} and "\u00a0" not in "".join(r.text for r in got)


def test_p10_pieces_alone_hold_the_limit():
    """Without spaces pieces are cut inside words, where a piece alone can have more tokens than in its text."""
    rng, t = random.Random(7), tokens()
    for alphabet in ("abcdefghij", "АБВГДежз", "中文字符号测试", "aé中😀"):
        body = "".join(rng.choice(alphabet) for _ in range(6000))
        parts = p10_split.pieces_of(body, t, 256, 32)
        assert len(parts) > 3 and max(t.count(p[4]) for p in parts) <= 256
