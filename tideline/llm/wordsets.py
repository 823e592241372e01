"""Texts as word sequences: one pass over a table gives a compact row a text, on which all similarity work runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.sketch import mix, row_ids
from tideline.llm.textforms import word_hash, words

#: Similarity counts only where both texts have this many distinct words.
LEAST_WORDS = 8
SCHEMA = "key string, cls long, n int, seq array<int>"


def word_rows(df: DataFrame, key: str, text: str, least: int = LEAST_WORDS) -> DataFrame:
    """``key``, ``cls`` (64-bit hash of the set of words: equal sets, equal class), ``n`` distinct words, ``seq`` (hashed words in order).

    Null keys, null texts and texts of fewer than ``least`` distinct words give no row. Repeated rows stay; they fall together
    under (cls, key). Words are hashed to 32 bits: a wrong match within a pair has a chance under 1 in a million."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for t in batch.column(1).to_pylist():
                flat += [word_hash(w) for w in words(t)]
                ends.append(len(flat))
            values, offsets = np.array(flat, np.uint32), np.array(ends, np.int64)
            cls, n = set_hashes(values, offsets)
            kept = n >= least
            inside = np.repeat(kept, np.diff(offsets))
            starts = np.concatenate([[0], np.cumsum(np.diff(offsets)[kept])])
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values[inside].view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(kept)), pa.array(cls[kept]), pa.array(n[kept], pa.int32()), lists], ["key", "cls", "n", "seq"])

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.where("key is not null and text is not null and length(text) >= " + str(2 * least - 1)).mapInArrow(run, SCHEMA)


def set_hashes(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of the set of values, number of distinct values) of each row; the hash is a sum over the set, so order doesn't matter."""
    n = len(offsets) - 1
    both = np.unique(row_ids(offsets).astype(np.uint64) << np.uint64(32) | values)
    rows, item = (both >> np.uint64(32)).astype(np.int64), mix((both & np.uint64(0xFFFFFFFF)) + np.uint64(0x51ED270B9A4B3D2F))
    counts = np.bincount(rows, minlength=n)
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(item, dtype=np.uint64)])
    ends = np.cumsum(counts)
    total = running[ends] - running[ends - counts]
    return mix(total ^ counts.astype(np.uint64)).view(np.int64), counts


def flat_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (as unsigned words) and offsets of a list column, offsets starting at 0."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.int32)
    return np.ascontiguousarray(values, dtype=np.int32).view(np.uint32), offsets - (offsets[0] if len(offsets) else 0)


def frequent_words(rows: DataFrame, share: float = 1e-3) -> tuple[np.ndarray, np.ndarray, int]:
    """Words standing in at least ``share`` of all rows: hashes (sorted), numbers of rows, and the number of all rows.

    The counts cover every row: each task counts its own rows' distinct words, the totals are one small aggregation. What
    comes to the driver has at most (mean distinct words a row) / share entries, however large the corpus: 28,000 for 28 words and 0.001."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows_seen = [], 0

        def counted(merge: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            w = np.concatenate([m[0] for m in merge])
            u, inverse = np.unique(w, return_inverse=True)
            return u, np.bincount(inverse, np.concatenate([m[1] for m in merge]), len(u)).astype(np.int64)

        for batch in batches:
            values, offsets = flat_of(batch.column(0))
            rows_seen += batch.num_rows
            if not len(values):
                continue
            distinct = np.unique(row_ids(offsets).astype(np.uint64) << np.uint64(32) | values)
            u, c = np.unique((distinct & np.uint64(0xFFFFFFFF)).astype(np.int64), return_counts=True)
            parts.append((u, c))
            if len(parts) >= 64:
                parts = [counted(parts)]
        if parts:
            u, c = counted(parts)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c)], ["w", "c"])
        if rows_seen:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([rows_seen], pa.int64())], ["w", "c"])

    counts = rows.select("seq").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))
    total = rows.count()
    found = counts.where((F.col("w") >= 0) & (F.col("c") >= max(2.0, share * total))).toPandas()
    order = found["w"].to_numpy(np.int64).argsort()
    return found["w"].to_numpy(np.int64)[order].astype(np.uint32), found["c"].to_numpy(np.int64)[order], total


#: Largest key filter in bits (16 MB); with more keys it lets more through, never fewer.
MOST_BITS = 1 << 27


def key_filter(keys: DataFrame, column: str, most_bits: int = MOST_BITS) -> np.ndarray:
    """A Bloom filter (packed bits, two probes) of a long column, to spare rows that can't match a shuffle.

    Tasks set bits in their own bitmap and send the blocks they touched, blocks are merged by or; what the driver receives and
    the tasks get is at most ``most_bits`` bits, whatever the number of keys."""
    n = keys.count()
    bits = 1 << 13
    while bits < min(most_bits, 12 * n):
        bits *= 2
    block = 1 << 13  # bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for batch in batches:
            for p in probes(batch.column(0).to_numpy(), bits):
                own[p] = True
        packed = np.packbits(own).reshape(-1, min(block, bits // 8))
        used = np.flatnonzero(packed.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([packed[i].tobytes() for i in used], pa.binary())], ["i", "b"])

    def merge(pdf):
        import pandas as pd

        return pd.DataFrame({"i": pdf["i"][:1], "b": [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["b"]]).tobytes()]})

    got = keys.select(column).mapInArrow(run, "i long, b binary").groupBy("i").applyInPandas(merge, "i long, b binary").toPandas()
    out = np.zeros((max(1, bits // 8 // block), min(block, bits // 8)), np.uint8)
    for i, b in zip(got["i"], got["b"]):
        out[i] = np.frombuffer(b, np.uint8)
    return out.reshape(-1)


def probes(values: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(values.view(np.uint64) if values.dtype == np.int64 else values.astype(np.int64).view(np.uint64))
    return [(h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)]


def may_have(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """False only for values that the filter's keys don't have."""
    out = np.ones(len(values), bool)
    for p in probes(values, len(bitmap) * 8):
        out &= (bitmap[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
    return out


def with_keys(rows: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """Rows whose ``cls`` the key filter may have; the others are spared the shuffle of an exact join after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_have(bitmap, batch.column(0).to_numpy())))

    return rows.select("cls", "n", "seq").mapInArrow(run, "cls long, n int, seq array<int>")
