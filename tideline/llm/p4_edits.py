"""Problem 4: near-duplicate records with small edits.

Method: Order MinHash. Of every text's occurrence-labelled words, ``SKETCHES`` samples of the ``LENGTH`` words with the smallest
hashes are drawn and kept in text order (read round the end, so a sentence moved to the front keeps its samples). Frequent
and rare words count alike, so edited copies that hold a large part of all rows are found like any others. Texts sharing a sample are candidates; each is verified by banded
alignment: e word edits leave at least max(n, m) - e distinct words in common, which decides where it suffices; the exact similarity
of the word sets decides the rest (texts whose parts change places).

Texts with equal word sets are one class before anything is compared; classes are expanded only in the result (`groups` doesn't: it
gives each key its class, component and numbers of copies and links). Sample keys are spread by hash in one shuffle; pairs of a
short run are made where it lies, those of a hot key by a join of blocks with blocks (`split_join`); no group is gathered.

Recall: of a pair with c of u occurrence-labelled words in common, a sample is shared with chance C(c,5)/C(u,5), whatever the words'
frequency; all 32 miss it with chance 0.003 at 0.7 for long texts (s^5), 0.012 for a union of 20 words, 0.06 for one of 10. Words
that change places or stand a different number of times lower the chance of a sample, though not the similarity of the word sets.

Cases: null keys or texts and texts under 8 distinct words are in no pair; repeated rows are one record; a key with two texts
pairs by either; very long texts are whole (the band grows no further than ``BAND``, beyond it the edits are null); empty tables
give empty results; extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.sketch import banded_distance, class_counts, order_samples, parity_codes, parity_near, row_ids
from tideline.llm.wordsets import flat_of, key_filter, may_have, with_keys, word_rows
from tideline.operators.staging import stage

SKETCHES, LENGTH, SEED, BAND, CLASSES = 32, 5, 7, 12, 32
#: Runs of equal samples longer than this are paired by a join; every run is paired.
HOT_RUN = 256
#: Rows of one sample that meet in one place at most; more are cut into blocks.
HOT_BLOCK = 1024
#: Samples that one task sorts, in memory.
SORTED = 1_500_000


def samples(rows: DataFrame, sketches: int = SKETCHES, length: int = LENGTH, seed: int = SEED, ordered: bool = True, only: np.ndarray | None = None) -> DataFrame:
    """(``sample``, ``cls``, ``code``): the samples of every row; with ``only``, a key filter, those that it may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = flat_of(batch.column(1))
            keys = order_samples(values, offsets, sketches, length, seed, ordered)
            classes, codes, flat = np.repeat(batch.column(0).to_numpy(), sketches), np.repeat(parity_codes(values, offsets), sketches), keys.reshape(-1).view(np.int64)
            if only is not None:
                kept = may_have(only, flat)
                classes, codes, flat = classes[kept], codes[kept], flat[kept]
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(classes), pa.array(codes)], ["sample", "cls", "code"])

    return rows.select("cls", "seq").mapInArrow(run, "sample long, cls long, code long")


def codes_near(a: str, b: str, least: float) -> Column:
    """`parity_near` on columns."""
    x, y = F.col(a).bitwiseAND(255), F.col(b).bitwiseAND(255)
    differ = F.bit_count(F.shiftrightunsigned(F.col(a).bitwiseXOR(F.col(b)), 8))
    return (F.greatest(x, y) == 255) | ((differ <= (1 - least) / (1 + least) * (x + y) + 1e-9) & (F.least(x, y) >= least * F.greatest(x, y) - 1e-9))


def candidates(keys: DataFrame, hot_run: int = HOT_RUN, least: float = 0.0, parts: int | None = None) -> DataFrame:
    """Pairs of classes (``a`` < ``b``) that share a sample, in one shuffle of the samples.

    Sorted by sample, the rows of a task are runs; runs of up to ``hot_run`` rows are paired on the spot. Longer ones are not
    held: their rows pass on and are paired by a join, which splits a hot sample over tasks. Pairs whose codes (where ``keys`` has
    them) show that they can't have similarity ``least`` are dropped where they are made."""
    keys = keys.select("sample", "cls", "code" if "code" in keys.columns else F.lit(255).cast("long").alias("code"))

    def paired(sample: np.ndarray, cls: np.ndarray, code: np.ndarray) -> list[np.ndarray]:
        edge = np.flatnonzero(np.r_[True, sample[1:] != sample[:-1]])
        size = np.diff(np.r_[edge, len(sample)])
        out = []
        for n in np.unique(size[size > 1]).tolist():
            start = edge[size == n]
            i, j = np.triu_indices(n, 1)
            for part in (start[k : k + max(1, 2_000_000 // len(i))] for k in range(0, len(start), max(1, 2_000_000 // len(i)))):
                p, q = (part[:, None] + i).reshape(-1), (part[:, None] + j).reshape(-1)
                x, y = cls[p], cls[q]
                keep = (x != y) & parity_near(code[p], code[q], least)
                out.append(np.unique(np.stack([np.minimum(x, y)[keep], np.maximum(x, y)[keep]], 1), axis=0))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for p in found:
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), pa.nulls(len(p), pa.int64()), pa.nulls(len(p), pa.int64())], ["a", "b", "sample", "code"])

        def passed(sample: np.ndarray, cls: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(cls), pa.nulls(len(cls), pa.int64()), pa.array(sample), pa.array(code)], ["a", "b", "sample", "code"])

        s, c, d, hot = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            s, c, d = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((s, c, d)))
            if hot is not None:
                n = int(np.searchsorted(s != hot, True))
                if n:
                    yield passed(s[:n], c[:n], d[:n])
                    s, c, d = s[n:], c[n:], d[n:]
            if len(s):
                last = int(np.flatnonzero(s != s[-1])[-1]) + 1 if s[0] != s[-1] else 0  # the last run may go on
                edge = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                size = np.diff(np.r_[edge, len(s)])
                long_ = np.repeat(size > hot_run, size)
                if long_.any():
                    yield passed(s[long_], c[long_], d[long_])
                    hot = s[-1] if long_[-1] else hot
                    if long_[-1]:
                        last = len(s)
                done = np.arange(len(s)) < last
                yield from pairs(paired(s[done & ~long_], c[done & ~long_], d[done & ~long_]))
                s, c, d = s[~done], c[~done], d[~done]
        yield from pairs(paired(s, c, d))

    spread = keys.repartition("sample") if parts is None else keys.repartition(parts, "sample")
    found = stage(spread.sortWithinPartitions("sample").mapInArrow(run, "a long, b long, sample long, code long"), "sample-pairs")
    hot = found.where("b is null").select("sample", "a", F.col("code").alias("ca")).distinct()
    if not hot.isEmpty():
        hot = stage(hot, "hot-samples")
    across = split_join(hot, hot.withColumnsRenamed({"a": "b", "ca": "cb"})).where("a < b").where(codes_near("ca", "cb", least)).select("a", "b")
    return found.where("b is not null").select("a", "b").unionByName(across).distinct()


def split_join(left: DataFrame, right: DataFrame, block: int = HOT_BLOCK) -> DataFrame:
    """Equal join on ``sample`` of two staged tables (an id and a code each) in which no join key has more than about ``block`` rows a side.

    A sample that has more is cut into blocks by hash on both sides, and every block of the left meets every block of the right under a
    key of its own, so its pairs are spread over as many tasks as there are pairs of blocks."""
    x, y = left.columns[1], right.columns[1]
    sizes = left.groupBy("sample").agg(F.count("*").alias("nl")).join(right.groupBy("sample").agg(F.count("*").alias("nr")), "sample")
    hot = stage(sizes.where(f"nl > {block} or nr > {block}").select("sample", F.ceil(F.col("nl") / block).cast("int").alias("bl"), F.ceil(F.col("nr") / block).cast("int").alias("br")), "hot-sizes")
    if hot.isEmpty():
        return left.join(right, "sample")
    plain = left.join(hot, "sample", "left_anti").join(right, "sample")
    place = lambda column, blocks: F.pmod(F.xxhash64(column), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    l = left.join(hot, "sample").withColumn("kl", place(x, "bl")).withColumn("kr", every("br")).drop("bl", "br")  # noqa: E741
    r = right.join(hot, "sample").withColumn("kr", place(y, "br")).withColumn("kl", every("bl")).drop("bl", "br")
    return plain.unionByName(l.join(r, ["sample", "kl", "kr"]).drop("kl", "kr"))


def vocabulary_counts(rows: DataFrame) -> DataFrame:
    """``cls``, ``n`` and ``counts``: a byte for the distinct words in each of ``CLASSES`` vocabulary classes; one row a class of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = flat_of(batch.column(2))
            both = np.unique(row_ids(offsets).astype(np.uint64) << np.uint64(32) | values)
            ends = np.concatenate([[0], np.cumsum(np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=batch.num_rows))]).astype(np.int64)
            counts = np.minimum(class_counts((both & np.uint64(0xFFFFFFFF)).astype(np.uint32), ends, CLASSES), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in counts], pa.binary())], ["cls", "n", "counts"])

    one = rows.select("cls", "n", "seq").mapInArrow(run, "cls long, n int, counts binary")
    return one.groupBy("cls").agg(F.first("n").alias("n"), F.first("counts").alias("counts"))


def verified(pairs: DataFrame, rows: DataFrame, least: float, band: int = BAND) -> DataFrame:
    """``a``, ``b``, ``similarity`` (at least ``least``), ``edits`` (word edits within the band, else null) of staged pairs of classes.

    First counts of words by vocabulary class are compared: their differences never add up to more than the words the texts
    don't share, so what is pruned can't be similar. Only what is left fetches the words."""
    small = vocabulary_counts(with_keys(rows, ends_filter(pairs)))
    both = pairs.join(small.withColumnsRenamed({"cls": "a", "n": "na", "counts": "ca"}), "a").join(small.withColumnsRenamed({"cls": "b", "n": "nb", "counts": "cb"}), "b")
    both = both.where(F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(i).to_numpy() for i in range(4))
            if len(a):
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, CLASSES).astype(np.int16) for i in (4, 5))
                keep = np.abs(x - y).sum(1) <= (1 - least) / (1 + least) * (na + nb) + 1e-9
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    near = stage(both.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(prune, "a long, b long"), "likely-pairs")
    text = one_a_class(with_keys(rows, ends_filter(near))).select("cls", "seq")
    words = near.join(text.withColumnsRenamed({"cls": "a", "seq": "sa"}), "a").join(text.withColumnsRenamed({"cls": "b", "seq": "sb"}), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            (va, oa), (vb, ob) = flat_of(batch.column(2)), flat_of(batch.column(3))
            edits = banded_distance([va[oa[i] : oa[i + 1]] for i in range(len(a))], [vb[ob[i] : ob[i + 1]] for i in range(len(a))], band)
            keep, sims = [], []
            for i in range(len(a)):
                x, y = set(va[oa[i] : oa[i + 1]].tolist()), set(vb[ob[i] : ob[i + 1]].tolist())
                # an edit takes at most one word from either set, so the alignment alone shows many pairs to be similar
                sure = max(len(x), len(y)) - edits[i] if edits[i] >= 0 else 0
                common = len(x & y)
                if sure >= least * (len(x) + len(y) - sure) or common >= least * (len(x) + len(y) - common) - 1e-9:
                    keep.append(i)
                    sims.append(common / (len(x) + len(y) - common))
            edits = edits[keep]
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(sims, pa.float64()), pa.array(edits, pa.int64(), mask=edits < 0)], ["a", "b", "similarity", "edits"])

    return words.select("a", "b", "sa", "sb").mapInArrow(verify, "a long, b long, similarity double, edits long")


def ends_filter(pairs: DataFrame) -> np.ndarray:
    return key_filter(pairs.select(F.explode(F.array("a", "b")).alias("cls")), "cls")


def one_a_class(rows: DataFrame) -> DataFrame:
    """One row of each class; the smallest word sequence, so that every run takes the same."""
    return rows.groupBy("cls").agg(F.min("n").alias("n"), F.min("seq").alias("seq"))


def class_links(rows: DataFrame, least: float) -> DataFrame:
    """Links between different classes of the staged word rows; the whole search."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * SKETCHES // SORTED))
    return verified(stage(candidates(samples(rows), least=least, parts=parts), "near-pairs"), rows, least)


def near_duplicates(df: DataFrame, key: str, text: str, least: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(links between classes, members): ``a, b, similarity, edits`` and ``cls, key``."""
    rows = stage(word_rows(df, key, text), "word-rows")
    return class_links(rows, least), rows.select("cls", "key").distinct()


def pairs_of_keys(links: DataFrame, members: DataFrame) -> DataFrame:
    """Every pair of different keys in linked classes or in one class, the smaller key first, once."""
    a, b = members.select(F.col("cls").alias("a"), F.col("key").alias("x")), members.select(F.col("cls").alias("b"), F.col("key").alias("y"))
    across = links.select("a", "b").join(a, "a").join(b, "b").where("x != y")
    many = members.groupBy("cls").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("cls")
    inside = members.join(many, "cls", "left_semi")
    within = inside.select("cls", F.col("key").alias("x")).join(inside.select("cls", F.col("key").alias("y")), "cls").where("x < y")
    out = across.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).unionByName(within.select(F.col("x").alias("key_a"), F.col("y").alias("key_b")))
    return out.distinct()


def components(links: DataFrame) -> DataFrame:
    """``cls``, ``component`` (its smallest class) of every class in ``links`` (``a``, ``b``): large stars and small stars in turn until nothing changes.

    A round is two aggregations and joins over the edges, which only get fewer; rounds grow with the logarithm of the longest chain."""
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large.where("u != v"), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = stage(small, "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("cls"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("cls"), F.col("v").alias("component"))).distinct()


def groups(df: DataFrame, key: str, text: str, least: float = 0.7) -> DataFrame:
    """Membership: ``key``, ``cls``, ``component`` (class it is linked to, directly or through others, with the smallest number), ``copies`` (keys of the
    class), ``links`` (other classes it is linked to)."""
    links, members = near_duplicates(df, key, text, least)
    links = stage(links, "links")
    degree = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("links"))
    copies = members.groupBy("cls").agg(F.count("*").alias("copies"))
    one = copies.join(degree, "cls", "left").join(components(links), "cls", "left").na.fill(0, ["links"]).where("copies > 1 or links > 0")
    return members.join(one, "cls").select("key", "cls", F.coalesce("component", "cls").alias("component"), "copies", "links")
