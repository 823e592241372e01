"""Problem 7: new batches against all history.

Method: pivot-distance table. Two kinds of fixed pivots are stored for every value of the history:

* ``CLASSES`` pivots that are fixed classes of the vocabulary. In the symmetric-difference metric of word sets the distance to
  such a pivot is |pivot| + |x| - 2 |x ∩ pivot|, so the number of words in the class stores it. By the triangle inequality the
  differences of two values' distances, summed over the disjoint pivots, never exceed their own distance: a pair whose sum is
  larger than (1-s)/(1+s) of their sizes can't have similarity s and is pruned without looking at the words.
* ``POINTS`` pivots that are points of a hash circle: the distances from a point to its ``NEAREST`` nearest words of the value.
  Near-duplicates have equal ones with the chance that those words are common to both. The table is hash-partitioned by these
  distances and a batch is joined on equality, the range of width zero; a wider range on class pivots alone leaves 2.7 per cent
  of all pairs (measured), which no join over all history can afford.

What survives both is verified by the true Jaccard distance. `PivotTable` stores both kinds of distances; accepted rows are appended to
it, so a later batch reads the folders it touches, not the texts. Hot distances are joined block by block (`split_join`). Within the incoming rows, values are taken in order of (batch, key): a value is known when it is near
a value of the history or an accepted earlier one. This is solved in rounds over the links between different values, each round
deciding every value whose earlier neighbours are decided; copies of one value are one class, decided by its first row.

Recall against the exact definition, whatever the words' frequency: 1 - (1 - C(c,5)/C(u,5))^36 for c of u words in common; at 0.7
0.9987 for long values (s^5), 0.993 for a union of 20 words, 0.96 for one of 10.

Cases: null keys or values and values under 8 distinct words are never known nor stored; a row delivered twice is one record (its
first batch); ties in (batch, key) can't differ; an empty history or batch works; extra columns are ignored; texts are whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.p4_edits import codes_near, one_a_class, samples, split_join
from tideline.llm.sketch import class_counts, row_ids
from tideline.llm.wordsets import flat_of, key_filter, may_have, word_rows
from tideline.operators.staging import stage

POINTS, NEAREST, SEED, CLASSES, BUCKETS = 36, 5, 29, 32, 64
VALUES = "cls long, n int, pivots binary, seq array<int>"


def pivot_distances(classes: DataFrame) -> DataFrame:
    """``cls``, ``n``, ``pivots`` (a byte a vocabulary class), ``seq`` (distinct words, sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = flat_of(batch.column(2))
            rows = row_ids(offsets)
            both = np.unique(rows.astype(np.uint64) << np.uint64(32) | values)
            words, at = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), (both >> np.uint64(32)).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=batch.num_rows))]).astype(np.int64)
            counts = np.minimum(class_counts(words, ends, CLASSES), 255).astype(np.uint8)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words.view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in counts], pa.binary()), lists], ["cls", "n", "pivots", "seq"])

    return classes.select("cls", "n", "seq").mapInArrow(run, "cls long, n int, pivots binary, seq array<int>")


def _verify(pairs: DataFrame, left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``x``, ``y`` with similarity at least ``least``: first the stored distances to the pivots, then the words of what is left."""
    lp = left.select(F.col("cls").alias("x"), F.col("n").alias("nx"), F.col("pivots").alias("px"))
    rp = right.select(F.col("cls").alias("y"), F.col("n").alias("ny"), F.col("pivots").alias("py"))
    both = pairs.join(lp, "x").join(rp, "y").where(F.least("nx", "ny") >= least * F.greatest("nx", "ny") - 1e-9)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, nx, ny = (batch.column(i).to_numpy() for i in range(4))
            if not len(x):
                continue
            px = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, CLASSES).astype(np.int16)
            py = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, CLASSES).astype(np.int16)
            keep = np.abs(px - py).sum(1) <= (1 - least) / (1 + least) * (nx + ny) + 1e-9
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]), pa.array(y[keep])], ["x", "y"])

    near = both.select("x", "y", "nx", "ny", "px", "py").mapInArrow(prune, "x long, y long")
    words = near.join(left.select(F.col("cls").alias("x"), F.col("seq").alias("sx")), "x").join(right.select(F.col("cls").alias("y"), F.col("seq").alias("sy")), "y")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            (vx, ox), (vy, oy) = flat_of(batch.column(2)), flat_of(batch.column(3))
            keep = []
            for i in range(len(x)):
                a, b = vx[ox[i] : ox[i + 1]], vy[oy[i] : oy[i + 1]]
                common = len(np.intersect1d(a, b, assume_unique=True))
                if common >= least * (len(a) + len(b) - common) - 1e-9:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]), pa.array(y[keep])], ["x", "y"])

    return words.select("x", "y", "sx", "sy").mapInArrow(verify, "x long, y long")


def points_of(rows: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """``sample`` (distances to a point), ``cls``, ``code`` of every value; with ``only``, those that the key filter may have."""
    return samples(rows, POINTS, NEAREST, SEED, ordered=False, only=only)


def links_to(new: DataFrame, mine: DataFrame, old: DataFrame, theirs: Callable[[DataFrame], DataFrame], least: float) -> DataFrame:
    """Links (``x`` incoming, ``y`` stored) of staged points and values of incoming rows with staged points of the history.

    theirs: gives the values of (at least) the classes asked for."""
    near = split_join(new, old.withColumnsRenamed({"cls": "y", "code": "cy"})).where("x != y").where(codes_near("cx", "cy", least))
    near = stage(near.select("x", "y").distinct(), "pivot-pairs")
    some = theirs(near.select(F.col("y").alias("cls")).distinct()).groupBy("cls")
    some = stage(some.agg(F.first("n").alias("n"), F.first("pivots").alias("pivots"), F.first("seq").alias("seq")), "pivots-history")
    return _verify(near, mine, some, least)


def having(rows: DataFrame, column: str, only: np.ndarray) -> DataFrame:
    """Rows whose ``column`` the key filter may have; the others are dropped where they lie, before any shuffle."""
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_have(only, batch.column(at).to_numpy())))

    return rows.mapInArrow(run, rows.schema)


def new_points(incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged (points, values) of incoming rows."""
    one = stage(one_a_class(incoming), "incoming-classes")
    return stage(points_of(one).withColumnsRenamed({"cls": "x", "code": "cx"}), "pivot-rows"), stage(pivot_distances(one), "pivots-in")


def pairs_within(incoming: DataFrame, history: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(links incoming to history, links among incoming) between different classes; both inputs are staged word rows."""
    new, mine = new_points(incoming)
    old = stage(points_of(history, key_filter(new, "sample")).distinct(), "pivot-old")  # points that no incoming value has stay where they are
    theirs = lambda ends: pivot_distances(having(history.select("cls", "n", "seq"), "cls", key_filter(ends, "cls")))
    return links_to(new, mine, old, theirs, least), links_among(new, mine, least)


def links_among(new: DataFrame, mine: DataFrame, least: float) -> DataFrame:
    inner = split_join(new, new.withColumnsRenamed({"x": "y", "cx": "cy"})).where("x < y").where(codes_near("cx", "cy", least))
    return _verify(stage(inner.select("x", "y").distinct(), "pivot-inner"), mine, mine, least)


def known_values(incoming: DataFrame, history: DataFrame, least: float = 0.7) -> DataFrame:
    """``key`` of every incoming value already known; incoming: staged word rows with ``batch``; history: staged word rows."""
    return decided(incoming, history.select("cls"), *pairs_within(incoming, history, least))


def decided(incoming: DataFrame, classes: DataFrame, outer: DataFrame, inner: DataFrame) -> DataFrame:
    """``key`` of every incoming value known, from the classes that the history has and the links to it and among incoming values. Copies: all rows of a class that the history has are
    known, else all but the class's first. A class near an accepted class is known where its row comes later."""
    first = incoming.groupBy("cls").agg(F.min(F.struct("batch", "key")).alias("first"))
    inner = stage(inner, "links")
    there = incoming.select("cls").distinct().join(classes, "cls", "left_semi")
    old = stage(there.unionByName(outer.select(F.col("x").alias("cls"))).distinct(), "old-classes")
    order = first.join(old.withColumn("old", F.lit(True)), "cls", "left")
    order = stage(order.select("cls", "first", F.coalesce("old", F.lit(False)).alias("old")), "class-order")
    # links from a class (later) to an earlier one; only classes that the history doesn't know can be accepted
    left, right = order.select(F.col("cls").alias("x"), F.col("first").alias("fx"), F.col("old").alias("ox")), order.select(F.col("cls").alias("y"), F.col("first").alias("fy"), F.col("old").alias("oy"))
    both = inner.join(left, "x").join(right, "y").where("not ox and not oy")
    edges = stage(both.select(F.when(F.col("fx") > F.col("fy"), F.col("x")).otherwise(F.col("y")).alias("late"), F.when(F.col("fx") > F.col("fy"), F.col("y")).otherwise(F.col("x")).alias("early")), "edges")
    # rounds: a class without undecided earlier neighbours and without an accepted one is accepted; its later neighbours are known
    # the earliest undecided class is always decided, so the rounds end, however long a chain is
    refused = None
    while not edges.isEmpty():
        waiting = edges.select(F.col("late").alias("cls")).distinct()
        accepted = edges.select(F.col("early").alias("cls")).distinct().join(waiting, "cls", "left_anti")
        out = stage(edges.join(accepted.withColumnRenamed("cls", "early"), "early", "left_semi").select(F.col("late").alias("cls")).distinct(), "refused")
        refused = out if refused is None else refused.unionByName(out)
        edges = stage(edges.join(out.withColumnRenamed("cls", "late"), "late", "left_anti").join(out.withColumnRenamed("cls", "early"), "early", "left_anti"), "edges")
    known = old if refused is None else old.unionByName(refused).distinct()
    all_known = incoming.join(known, "cls", "left_semi").select("key")
    rest = incoming.join(known, "cls", "left_anti").join(first, "cls").where("struct(batch, key) > first").select("key")
    return all_known.unionByName(rest).distinct()


def first_delivery(df: DataFrame, key: str, batch: str, value: str) -> DataFrame:
    """One row a key: the batch it first came in, and that delivery's value."""
    one = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key"))
    return one.agg(F.min(F.struct(F.col(batch).alias("batch"), F.col(value).alias("value"))).alias("m")).select("key", F.col("m.batch").alias("batch"), F.col("m.value").alias("value"))


def known_in(incoming: DataFrame, key: str, batch: str, value: str, history: list[tuple[DataFrame, str, str]], least: float = 0.7) -> DataFrame:
    """Keys of incoming rows whose ``value`` is known; history: (table, key, value column) each."""
    one = first_delivery(incoming, key, batch, value)
    rows = stage(word_rows(one, "key", "value").join(one.select("key", "batch"), "key"), "incoming-rows")
    past = None
    for table, k, v in history:
        part = word_rows(table, k, v)
        past = part if past is None else past.unionByName(part)
    return known_values(rows, stage(past, "history-rows"), least)


class PivotTable:
    """The stored history of one field, appended batch by batch: under ``points`` the distances of every value to the points, under
    ``values`` its distances to the class pivots and its words. Both are cut into ``BUCKETS`` folders by range of the stored key.

    ``admit`` gives the known keys of a batch and appends the others. Nothing of the history is computed again: the batch's own distances
    name the folders to read, those of its candidates the folders of values. The pivots are fixed, whatever the history holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, name: str, schema: str) -> DataFrame:
        where = f"{self.path}/{name}"
        jvm = self.spark.sparkContext._jvm
        there = jvm.org.apache.hadoop.fs.Path(where)
        if not there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
            return self.spark.createDataFrame([], f"{schema}, bucket int")
        return self.spark.read.schema(f"{schema}, bucket int").parquet(where)

    def points(self) -> DataFrame:
        return self._folder("points", "sample long, cls long, code long")

    def values(self) -> DataFrame:
        return self._folder("values", VALUES)

    @staticmethod
    def _bucket(column: str):
        return F.shiftrightunsigned(column, 64 - BUCKETS.bit_length() + 1).cast("int")

    def _touched(self, stored: DataFrame, keys: DataFrame, column: str) -> DataFrame:
        """The rows in the folders of some keys; what comes to the driver is at most ``BUCKETS`` numbers."""
        wanted = [r.b for r in keys.select(self._bucket(column).alias("b")).distinct().collect()]
        return stored.where(F.col("bucket").isin(wanted)).drop("bucket")

    def append(self, df: DataFrame, key: str, value: str) -> None:
        """Stores the values; equal word sets are one value. A value stored twice changes nothing."""
        one = stage(one_a_class(word_rows(df, key, value)), "accepted")
        for name, rows, column in (("points", points_of(one), "sample"), ("values", pivot_distances(one), "cls")):
            rows.withColumn("bucket", self._bucket(column)).repartition("bucket").sortWithinPartitions("bucket", column).write.mode("append").partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/{name}")

    def admit(self, incoming: DataFrame, key: str, batch: str, value: str, least: float = 0.7) -> DataFrame:
        one = stage(first_delivery(incoming, key, batch, value), "delivery")
        rows = stage(word_rows(one, "key", "value").join(one.select("key", "batch"), "key"), "incoming-rows")
        new, mine = new_points(rows)
        old = stage(having(self._touched(self.points(), new, "sample"), "sample", key_filter(new, "sample")).distinct(), "pivot-old")
        outer = links_to(new, mine, old, lambda ends: having(self._touched(self.values(), ends, "cls"), "cls", key_filter(ends, "cls")), least)
        same = self._touched(self.values(), rows, "cls").select("cls")
        known = stage(decided(rows, same, outer, links_among(new, mine, least)), "known")
        self.append(one.join(known, "key", "left_anti"), "key", "value")
        return known
