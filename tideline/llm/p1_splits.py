"""Problem 1: same or near-same records across splits.

Method: compressed full-text index of evaluation shards. The word sequences of evaluation texts are indexed shard by shard
(run-length BWT); the training texts of the shard are streamed through backward search from their rare words, and every place found
is extended to a maximal match. The matches of a pair are merged to spans and the words they cover counted; pairs whose spans hold
too few words get an exact count of all words before they are given up.

Nothing is lost: texts of similarity s or more share one of their first n - ceil(s n) + 1 words in any fixed order of words
(rarest first here). Evaluation and training texts go to the shards of those words only, so the work grows with the records,
not with shards times records. A shard with too many texts is split into blocks of evaluation by blocks of training texts, so
a word in a third of all rows still makes bounded tasks. Equal word sets are one text throughout.

Cases: null ids, texts or splits and texts under 8 distinct words are in no pair; repeated rows are one record; a sentence in
both train and another split pairs with others, never itself; null sources are counted as a source of their own; empty tables
give empty results; extra columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.fmindex import WordIndex, extend
from tideline.llm.p4_edits import one_a_class
from tideline.llm.sketch import class_counts, mix, row_ids
from tideline.llm.wordsets import flat_of, frequent_words, word_rows
from tideline.operators.staging import stage

CLASSES = 32


def routed(classes: DataFrame, hot: np.ndarray, counts: np.ndarray, least: float, shards: int) -> DataFrame:
    """Each text once for every shard of its prefix words: ``shard``, ``cls``, ``anchors`` (its prefix words of the shard), ``seq``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = flat_of(batch.column(1))
            both = np.unique(row_ids(offsets).astype(np.uint64) << np.uint64(32) | values)
            row, word = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            n = np.bincount(row, minlength=batch.num_rows)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, word), len(hot) - 1)
                freq = np.where(hot[at] == word, counts[at], 0)
            else:
                freq = np.zeros(len(word), np.int64)
            order = np.lexsort((word, freq, row))
            row, word = row[order], word[order]
            place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
            first = place < (n - np.ceil(least * n - 1e-9).astype(np.int64) + 1)[row]
            row, word = row[first], word[first]
            shard = (mix(word.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((word, shard, row))
            row, word, shard = row[order], word[order], shard[order]
            begin = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])]) if len(row) else np.zeros(0, np.int64)
            anchors = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(row)], pa.int32()), pa.array(word.view(np.int32)))
            which = pa.array(row[begin])
            yield pa.RecordBatch.from_arrays([pa.array(shard[begin]), batch.column(0).take(which), anchors, batch.column(1).take(which)], ["shard", "cls", "anchors", "seq"])

    return classes.select("cls", "seq").mapInArrow(run, "shard long, cls long, anchors array<int>, seq array<int>")


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64()), ("shared", pa.int32()), ("spans", pa.int32()), ("longest", pa.int32())])


class Side:
    """The texts of one side of a shard: flat words, where each text starts, distinct words, their number and counts by vocabulary class."""

    def __init__(self, table: pa.Table):
        self.cls = table.column("cls").to_numpy()
        values, self.starts = flat_of(table.column("seq").combine_chunks())
        self.flat = values.astype(np.int64)
        self.texts = [self.flat[a:b] for a, b in zip(self.starts[:-1], self.starts[1:])]
        both = np.unique(np.repeat(np.arange(len(self.texts)), np.diff(self.starts)) << 32 | self.flat)
        self.sets = both  # text << 32 | word, sorted
        self.n = np.bincount(both >> 32, minlength=len(self.texts))
        self.ends = np.concatenate([[0], np.cumsum(self.n)])
        self.pivots = class_counts((both & 0xFFFFFFFF).astype(np.uint32), self.ends, CLASSES)


def spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, element) of the ranges [first, first + size)."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


def shared_words(t: Side, h: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distinct words that texts i and j have in common."""
    which, at = spread(t.ends[i], t.n[i])
    asked = j[which] << 32 | (t.sets[at] & 0xFFFFFFFF)
    got = np.minimum(np.searchsorted(h.sets, asked), len(h.sets) - 1)
    return np.bincount(which, h.sets[got] == asked, len(i)).astype(np.int64)


def search_shard(train: pa.Table, held: pa.Table, least: float, step: int = 500_000) -> pa.Table:
    """Pairs of one shard: ``a`` (train class), ``b`` (evaluation class), ``similarity``, ``shared`` words, ``spans`` and ``longest`` of the merged matches.

    Backward search of the train texts' anchors gives where evaluation texts have them; around each the match is maximal. The matches of
    a pair are merged, and the words they cover are counted. A pair whose count suffices is found; where it doesn't, words outside these
    matches may still be shared, and are added before the pair is given up. About ``step`` located entries are held at a time."""
    out: list[pa.Table] = []
    if train.num_rows and held.num_rows:
        t, h = Side(train), Side(held)
        index = WordIndex(h.texts)
        anchor, of = flat_of(train.column("anchors").combine_chunks())
        wanted = np.unique(row_ids(of) << 32 | anchor.astype(np.int64))
        row = np.repeat(np.arange(len(t.texts)), np.diff(t.starts))
        key = row << 32 | t.flat
        end = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key)
        low, high = index.search(index.codes(t.flat[end]), np.zeros(len(end), np.int64), np.full(len(end), index.n, np.int64))
        # a part ends between texts, so that all matches of a pair are together
        cuts = np.flatnonzero((np.diff(np.cumsum(high - low) // step) > 0)) + 1
        cuts = np.unique(np.searchsorted(row[end], row[end[cuts]]))
        for part in np.split(np.arange(len(end)), cuts[(cuts > 0) & (cuts < len(end))]):
            which, j, to = index.locate(low[part], high[part])
            at = end[part][which]
            i = row[at]
            fits = (np.minimum(t.n[i], h.n[j]) >= least * np.maximum(t.n[i], h.n[j]) - 1e-9)
            at, i, j, to = at[fits], i[fits], j[fits], to[fits]
            pair, back = np.unique(i * len(h.texts) + j, return_inverse=True)
            x, y = pair // len(h.texts), pair % len(h.texts)
            near = np.abs(t.pivots[x] - h.pivots[y]).sum(1) <= (1 - least) / (1 + least) * (t.n[x] + h.n[y]) + 1e-9
            keep = near[back]
            at, i, j, to, back = at[keep], i[keep], j[keep], to[keep], back[keep]
            if not len(at):
                continue
            first, last = extend(t.flat, t.starts[i], t.starts[i + 1], h.flat, h.starts[j], h.starts[j + 1], at, h.starts[j] + to)
            span = np.unique(np.stack([back, first, last], 1), axis=0)
            fresh = np.r_[True, (span[1:, 0] != span[:-1, 0]) | (span[1:, 1] > span[:-1, 2])]  # overlapping matches are one span
            p, place = spread(span[:, 1], span[:, 2] - span[:, 1])
            words = np.unique(np.stack([span[p, 0], t.flat[place]], 1), axis=0)
            count = np.bincount(words[:, 0], minlength=len(pair))
            spans = np.bincount(span[fresh, 0], minlength=len(pair))
            longest = np.zeros(len(pair), np.int64)
            np.maximum.at(longest, span[:, 0], span[:, 2] - span[:, 1])
            live = np.flatnonzero(near)
            x, y, count, spans, longest = x[live], y[live], count[live], spans[live], longest[live]
            enough = lambda c: c >= least * (t.n[x] + h.n[y] - c) - 1e-9
            by_spans = enough(count)
            shared = np.where(by_spans, count, 0)
            shared[~by_spans] = shared_words(t, h, x[~by_spans], y[~by_spans])
            found = enough(shared)
            x, y, spans, longest = x[found], y[found], spans[found], longest[found]
            shared = shared_words(t, h, x, y)  # few; the report needs the exact similarity
            got = {"a": t.cls[x], "b": h.cls[y], "similarity": shared / (t.n[x] + h.n[y] - shared), "shared": shared, "spans": spans, "longest": longest}
            out.append(pa.table({c: pa.array(v, kind) for (c, v), kind in zip(got.items(), PAIRS.types)}, schema=PAIRS))
    return pa.concat_tables(out) if out else PAIRS.empty_table()


def class_overlaps(train: DataFrame, held: DataFrame, least: float, texts_a_shard: int = 4000) -> DataFrame:
    """Pairs of classes (train ``a``, held out ``b``) of staged word rows, also a class with itself where both have it."""
    both = train.select("cls", "seq").unionByName(held.select("cls", "seq"))
    hot, counts, total = frequent_words(both, 1e-4)
    shards = max(4, math.ceil(total * 6 / texts_a_shard))
    sides = [stage(routed(one_a_class(x), hot, counts, least, shards), "routed") for x in (train, held)]
    sizes = [x.groupBy("shard").agg(F.ceil(F.count("*") / (2 * texts_a_shard)).cast("int").alias(c)) for x, c in zip(sides, ("blocks_t", "blocks_h"))]
    plan = sizes[0].join(sizes[1], "shard")  # shards that only one side has can't hold a pair
    t = sides[0].join(plan, "shard").withColumn("bt", F.pmod(F.xxhash64("cls"), F.col("blocks_t")).cast("int")).withColumn("bh", F.explode(F.sequence(F.lit(0), F.col("blocks_h") - 1)))
    h = sides[1].join(plan, "shard").withColumn("bh", F.pmod(F.xxhash64("cls"), F.col("blocks_h")).cast("int")).withColumn("bt", F.explode(F.sequence(F.lit(0), F.col("blocks_t") - 1)))
    keys = ["shard", "bt", "bh"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return search_shard(a, b, least)

    found = t.select(*keys, "cls", "anchors", "seq").groupBy(*keys).cogroup(h.select(*keys, "cls", "seq").groupBy(*keys)).applyInArrow(run, "a long, b long, similarity double, shared int, spans int, longest int")
    return found.groupBy("a", "b").agg(F.first("similarity").alias("similarity"), F.first("shared").alias("shared"), F.min("spans").alias("spans"), F.max("longest").alias("longest"))


def overlaps(df: DataFrame, key: str = "sentence_id", text: str = "text", split: str = "split", least: float = 0.8) -> DataFrame:
    """``key_t`` (train), ``key_e`` (evaluation), ``split``, ``similarity``, ``shared``, ``spans``, ``longest`` for every overlapping pair of keys."""
    rows = df.where(F.col(key).isNotNull() & F.col(split).isNotNull())
    is_train = F.lower(F.trim(F.col(split))) == "train"
    train, held = (stage(word_rows(x, key, text), n) for x, n in ((rows.where(is_train), "train-rows"), (rows.where(~is_train), "held-rows")))
    pairs = stage(class_overlaps(train, held, least), "overlaps")
    a, b = train.select(F.col("cls").alias("a"), F.col("key").alias("key_t")).distinct(), held.select(F.col("cls").alias("b"), F.col("key").alias("key_e")).distinct()
    named = rows.where(~is_train).select(F.col(key).cast("string").alias("key_e"), F.col(split).alias("split")).distinct()
    return pairs.join(a, "a").join(b, "b").where("key_t != key_e").join(named, "key_e").select("key_t", "key_e", "split", "similarity", "shared", "spans", "longest")


def found(df: DataFrame, key: str = "sentence_id") -> DataFrame:
    """Pairs of keys, the smaller first."""
    pairs = overlaps(df, key)
    return pairs.select(F.least("key_t", "key_e").alias(f"{key}_a"), F.greatest("key_t", "key_e").alias(f"{key}_b")).distinct()


def report(df: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per split and source: overlapping evaluation sentences, exact ones, and those whose true_label agrees or not with the train label."""
    pairs = overlaps(df)
    fold = lambda c: F.lower(F.trim(F.col(c)))
    truth = predictions.where("sentence_id is not null and true_label is not null").groupBy(F.col("sentence_id").alias("key_e")).agg(F.max(fold("true_label")).alias("truth"))
    label = df.where("sentence_id is not null and label is not null").groupBy(F.col("sentence_id").alias("key_t")).agg(F.max(fold("label")).alias("label"))
    source = df.where("sentence_id is not null").groupBy(F.col("sentence_id").alias("key_e")).agg(F.max("source").alias("source"))
    each = pairs.join(truth, "key_e", "left").join(label, "key_t", "left").join(source, "key_e", "left")
    one = each.groupBy("split", "source", "key_e").agg(F.max(F.when(F.col("similarity") == 1.0, 1).otherwise(0)).alias("same"), F.max(F.when(F.col("truth") == F.col("label"), 1).otherwise(0)).alias("agree"), F.max(F.when(F.col("truth") != F.col("label"), 1).otherwise(0)).alias("differ"), F.count("*").alias("pairs"))
    return one.groupBy("split", "source").agg(F.count("*").alias("sentences"), F.sum("same").alias("exact"), F.sum("pairs").alias("pairs"), F.sum("agree").alias("label_agrees"), F.sum("differ").alias("label_differs"))
