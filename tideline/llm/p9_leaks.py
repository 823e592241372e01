"""Problem 9: evaluation texts leaking into training text.

Method: q-gram lemma filtering. Items and documents are brought to words joined by single spaces. A passage of ``RUN`` words of an
item, of at least L characters, that stands in a document with at most ``EDITS`` characters edited shares at least
L - q + 1 - q * EDITS of its character q-grams with it, all in a band of neighbouring diagonals (document place minus item place). Shared
q-grams are counted in overlapping bands; each region with enough is verified by banded alignment of its words, which gives the most
words in a row that are equal (no edit) and that are equal but for one word changed, put in or left out.
What `found` reports are the alignments without an edit; `leaks` has the near ones too: all with ``EDITS`` characters edited, and those
with a word changed whose other words share enough q-grams.

The items' index is built by tasks and written in blocks of about ``BLOCK`` items to the shared folder. Documents are cleaned and hashed
once, in one pass for any number of items, and never shuffled; each task takes the blocks one after another, and keeps at most
``HELD`` of them in memory.

Cases: null ids and texts give no row; items shorter than ``RUN`` words can't be found; a repeated passage is one row; documents of any
length are whole; two items with equal texts are both reported; empty tables give empty results; extra columns are ignored."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.p6_topn import open_parquet
from tideline.llm.textforms import word_hash, words
from tideline.operators.staging import stage

RUN, EDITS, BLOCK, HELD = 12, 1, 5000, 4
_BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q characters from each place on; built from hashes of halves."""
    with np.errstate(over="ignore"):
        have, size, power = points.astype(np.uint64) + np.uint64(1), 1, _BASE
        out, done = None, 0
        rest = q
        while rest:
            if rest & 1:
                if out is None:
                    out, done = have, size
                else:  # out covers the first ``done`` characters
                    n = len(points) - done - size + 1
                    if n <= 0:
                        return np.zeros(0, np.uint64)
                    out = out[:n] * power + have[done : done + n]
                    done += size
            rest >>= 1
            if rest:
                n = len(have) - size
                if n <= 0:
                    return np.zeros(0, np.uint64)
                have = have[:n] * power + have[size : size + n]
                size *= 2
                power = power * power
        n = len(points) - q + 1
        out = out[: max(0, n)]
        out = out ^ (out >> np.uint64(29))
        out = out * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def starts_of(listed: list[str]) -> np.ndarray:
    """Character where each word starts in the joined line, and the end plus one."""
    return np.cumsum([0] + [len(x) + 1 for x in listed])


class ItemIndex:
    """Sorted q-grams of a block of items, and each item's words."""

    def __init__(self, ids: list, texts: list[str], run: int = RUN, edits: int = EDITS):
        self.run, self.edits = run, edits
        kept = [(i, w) for i, w in ((i, words(t)) for i, t in zip(ids, texts)) if len(w) >= run]
        self.ids = [i for i, _ in kept]
        self.words = [np.array([word_hash(x) for x in w], np.int64) for _, w in kept]
        self.begins = [starts_of(w) for _, w in kept]
        least = np.array([int((b[run:] - b[:-run]).min()) - 1 for b in self.begins], np.int64)
        # the longest q that the lemma allows for every item, at most 24
        self.q = max(4, min(24, (int(least.min()) if len(least) else 24) // (edits + 1) - 1))
        self.need = np.maximum(1, least - self.q + 1 - self.q * edits)
        grams = [gram_hashes(_points(" ".join(w)), self.q) for _, w in kept]
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.gram, self.item, self.at = flat[order], item[order].astype(np.int64), at[order].astype(np.int64)

    BITS = 22

    def marked(self) -> np.ndarray:
        """A bitmap in front of the sorted q-grams."""
        if not hasattr(self, "bitmap"):
            self.bitmap = np.zeros(1 << self.BITS, bool)
            self.bitmap[(self.gram >> np.uint64(64 - self.BITS)).astype(np.int64)] = True
        return self.bitmap


class Documents:
    """A batch of documents as words: cleaned once, q-grams hashed once for each q."""

    def __init__(self, listed: list[list[str]]):
        self.listed = listed
        lines = [" ".join(d) for d in listed]
        self.starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])]).astype(np.int64)
        self.points = _points("\n".join(lines) + "\n")
        self.hashed: dict[int, np.ndarray] = {}
        self.coded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def grams(self, q: int) -> np.ndarray:
        if q not in self.hashed:
            self.hashed[q] = gram_hashes(self.points, q)
        return self.hashed[q]

    def words(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the words, characters where they start)."""
        if d not in self.coded:
            self.coded[d] = np.array([word_hash(x) for x in self.listed[d]], np.int64), starts_of(self.listed[d])
        return self.coded[d]


def regions(index: ItemIndex, docs: Documents) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(document, item, document places, item places) of the shared q-grams of every band that has enough of them."""
    if not len(index.gram) or not docs.listed:
        return []
    h = docs.grams(index.q)
    hit = np.flatnonzero(index.marked()[(h >> np.uint64(64 - index.BITS)).astype(np.int64)])
    low = np.searchsorted(index.gram, h[hit], "left")
    size = np.searchsorted(index.gram, h[hit], "right") - low
    hit, low, size = hit[size > 0], low[size > 0], size[size > 0]
    if not len(hit):
        return []
    entry = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
    place = np.repeat(hit, size)
    doc = np.searchsorted(docs.starts, place, "right") - 1
    place = place - docs.starts[doc]
    item, at = index.item[entry], index.at[entry]
    # bands of width edits + 1, each counted with its right neighbour: a passage drifting by at most ``edits`` lies wholly in two such
    band = np.floor_divide(place - at, index.edits + 1)
    low_band, bands = int(band.min()), int(band.max() - band.min()) + 2
    key = (doc * len(index.ids) + item) * bands + (band - low_band)
    order = np.argsort(key, kind="stable")
    key, place, at = key[order], place[order], at[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count, group = np.diff(np.r_[first, len(key)]), key[first]
    pair = group // bands
    need = index.need[pair % len(index.ids)]
    next_to = np.r_[(group[1:] == group[:-1] + 1) & (pair[1:] == pair[:-1]), False]  # the group's right neighbour has shared q-grams too
    both = count + np.where(next_to, np.r_[count[1:], 0], 0) >= need
    kept = both | np.r_[False, (both & next_to)[:-1]]
    out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    joins = np.r_[False, (kept[:-1] & kept[1:] & next_to[:-1])]
    begin = np.flatnonzero(kept & ~joins)
    end = np.flatnonzero(kept & ~np.r_[joins[1:], False])
    for f, last in zip(begin.tolist(), end.tolist()):  # kept neighbours are one region
        x, y = int(first[f]), int(first[last] + count[last])
        out.append((int(pair[f]) // len(index.ids), int(pair[f]) % len(index.ids), place[x:y], at[x:y]))
    return out


def align(index: ItemIndex, docs: Documents, found: list[tuple[int, int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each region: most words in a row that are equal, most that are equal but for one word edit, document word where the former start.

    The band is the word diagonals of the shared q-grams and one on either side. All regions advance together, an item word at a time."""
    out = np.zeros((len(found), 3), np.int64)
    spans = []
    for d, i, place, at in found:
        k, j = np.searchsorted(docs.words(d)[1], place, "right") - 1, np.searchsorted(index.begins[i], at, "right") - 1
        low, high = max(0, int(j.min()) - index.run), min(len(index.words[i]), int(j.max()) + index.q + index.run)
        spans.append((low, high - low, int((k - j).min()) - 1, int((k - j).max() - (k - j).min()) + 3))
    order = sorted(range(len(found)), key=lambda r: (spans[r][3], spans[r][1]))
    for part in (order[x : x + 512] for x in range(0, len(order), 512)):
        steps, wide = max(spans[r][1] for r in part), max(spans[r][3] for r in part)
        a, b = np.full((len(part), steps), -1, np.int64), np.full((len(part), steps + wide), -2, np.int64)
        for n, r in enumerate(part):
            (d, i, *_), (low, size, shift, _) = found[r], spans[r]
            a[n, :size] = index.words[i][low : low + size]
            dw = docs.words(d)[0]
            begin, end = max(0, low + shift), min(len(dw), low + shift + size + wide)
            if end > begin:
                b[n, begin - low - shift : end - low - shift] = dw[begin:end]
        exact, near = np.zeros((len(part), wide), np.int64), np.zeros((len(part), wide), np.int64)
        best = np.zeros((len(part), 3), np.int64)
        rows = np.arange(len(part))
        for t in range(steps):
            same = b[:, t : t + wide] == a[:, t : t + 1]
            other = exact.copy()  # a word changed
            other[:, :-1] = np.maximum(other[:, :-1], exact[:, 1:])  # left out of the document
            exact = np.where(same, exact + 1, 0)
            other[:, 1:] = np.maximum(other[:, 1:], exact[:, :-1])  # put in
            near = np.maximum(np.where(same, near + 1, other), exact)
            at = exact.argmax(1)
            top = exact[rows, at]
            more = top > best[:, 0]
            best[more, 0], best[more, 2] = top[more], (t + at - top + 1)[more]
            best[:, 1] = np.maximum(best[:, 1], near.max(1))
        best[:, 2] += [spans[r][0] + spans[r][2] for r in part]
        out[part] = best
    return out


def matches(index: ItemIndex, docs: Documents) -> list[tuple[int, int, int, int, int]]:
    """(document number, item number, words in a row, words with one edit, document word where the former start), one row a pair."""
    found = regions(index, docs)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for (d, i, *_), (exact, near, at) in zip(found, align(index, docs, found).tolist()):
        was = best.get((d, i), (0, 0, 0))
        best[d, i] = (exact, max(near, was[1]), at) if exact > was[0] else (was[0], max(near, was[1]), was[2])
    return [(d, i, *x) for (d, i), x in best.items() if x[1] >= index.run]


def index_blocks(items: DataFrame, item_key: str, item_text: str, run: int, edits: int) -> list[str]:
    """Builds the index in tasks and writes it to the shared folder; the files, each with some blocks."""
    listed = items.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    blocks = max(1, -(-listed.count() // BLOCK))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"body": [pickle.dumps(ItemIndex(pdf["i"].tolist(), pdf["t"].tolist(), run, edits))]})

    return stage(listed.withColumn("block", F.pmod(F.xxhash64("i"), F.lit(blocks))).groupBy("block").applyInPandas(build, "body binary"), "item-index").inputFiles()


@lru_cache(maxsize=HELD)
def block_of(path: str, group: int) -> list[ItemIndex]:
    return [pickle.loads(x) for x in open_parquet(path).read_row_group(group, columns=["body"]).column("body").to_pylist()]


def every_block(paths: list[str]) -> Iterator[ItemIndex]:
    for path in paths:
        for group in range(row_groups(path)):
            yield from block_of(path, group)


@lru_cache(maxsize=100_000)
def row_groups(path: str) -> int:
    return open_parquet(path).metadata.num_row_groups


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", run: int = RUN, edits: int = EDITS, batch_chars: int = 2_000_000) -> DataFrame:
    """``doc``, ``item``, ``words`` (most equal words in a row), ``near_words`` (most with one word edited), ``edits`` (0 or 1: the fewest with
    which ``run`` words are reached), ``at`` (document word where the equal ones start)."""
    paths = index_blocks(items, item_key, item_text, run, edits)
    rows = docs.select(F.col(doc_key).cast("long").alias("k"), F.col(doc_text).cast("string").alias("t")).where(f"k is not null and t is not null and length(t) >= {2 * run - 1}")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, keys, size = [], [], 0

        def flush() -> pd.DataFrame:
            batch = Documents(texts)
            out = [(keys[d], index.ids[i], n, m, 0 if n >= run else 1, w) for index in every_block(paths) for d, i, n, m, w in matches(index, batch)]
            return pd.DataFrame(out, columns=["doc", "item", "words", "near_words", "edits", "at"])

        for pdf in batches:
            for k, t in zip(pdf["k"], pdf["t"]):
                w = words(t)
                if len(w) < run:
                    continue
                texts.append(w)
                keys.append(k)
                size += len(t)
                if size > batch_chars:
                    yield flush()
                    texts, keys, size = [], [], 0
        yield flush()

    return rows.mapInPandas(scan, "doc long, item long, words int, near_words int, edits int, at int")


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(docs, items).where("edits = 0").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per leaked item: its benchmark and split, the documents holding it, those holding it with a word edited only, the longest run of words."""
    hits = leaks(docs, items).groupBy("doc", "item").agg(F.max("words").alias("words"), F.min("edits").alias("edits"))
    per = hits.groupBy(F.col("item").alias("item_id")).agg(F.sum((F.col("edits") == 0).cast("long")).alias("documents"), F.sum((F.col("edits") == 1).cast("long")).alias("near_documents"), F.max("words").alias("longest"))
    return per.join(items.select("item_id", "benchmark", "split").distinct(), "item_id")
