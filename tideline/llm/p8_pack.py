"""Problem 8: filling fixed-capacity containers with items.

Method: Martello-Toth dominance reduction, then best fit. Sizes are whole numbers up to the capacity, so the instance is its
histogram: at most ``capacity`` counts, whatever the number of documents. On the histogram small sets that provably dominate
every alternative are fixed in bulk, for every size and until nothing more can be fixed (an item that nothing fits beside; an item and
its exact complement; an item with one or two others, see `dominating`); what remains is packed by best fit, largest first. The plan has a few
patterns, each with how many containers repeat it.

Documents are then dealt to the plan by their rank within their size. Ranks come from counts per (size, bucket) and places
within a bucket, so no size, however frequent, is gathered in one task, and the same input gives the same containers.

Documents larger than a container are cut at multiples of the capacity; their last part is packed as an item.

Cases: null ids, null and empty texts have no tokens and no row; repeated ids are told apart by their place; ties in size go by id;
documents of any length are tokenised whole; an empty table gives an empty result; extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.tokens import VOCABULARY, tokens
from tideline.operators.staging import stage

CAPACITY, BUCKETS = 2048, 256


def sizes(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key``, ``n`` (tokens of the text); texts without tokens are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokens(vocabulary)
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "n": [t.count(x) for x in pdf["text"]]})

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).where("key is not null and text is not null and text != ''")
    return rows.mapInPandas(run, "key long, n long")


Plan = list[tuple[int, dict[int, int]]]  # (containers, {size: items in each})


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> tuple[Plan, np.ndarray]:
    """Fixes dominating sets in bulk; returns them and what is left. counts[s]: items of size s."""
    left = counts.astype(np.int64).copy()
    plan: Plan = []

    def fix(times: int, content: dict[int, int]) -> None:
        plan.append((int(times), content))
        for s, c in content.items():
            left[s] -= c * times

    if left[capacity]:
        fix(left[capacity], {capacity: 1})
    for s in range(capacity - 1, capacity // 2 - 1, -1):  # an item and its exact complement dominate any set with the item
        other = capacity - s
        if s == other:
            if left[s] >= 2:
                fix(left[s] // 2, {s: 2})
        elif left[s] and left[other]:
            fix(min(left[s], left[other]), {s: 1, other: 1})
    changed = True
    while changed:  # each pass tries every size, largest first; a set fixed can make another dominate
        changed = False
        for big in range(capacity, 0, -1):
            while left[big] and (found := dominating(left, big, capacity)):
                fix(*found)
                changed = True
    return plan, left


def dominating(left: np.ndarray, big: int, capacity: int) -> tuple[int, dict[int, int]] | None:
    """A set with an item of size ``big`` that dominates every other set with it, and how often it may be fixed at once; None if there is none.

    The cases of the reduction procedure: nothing fits beside the item; at most one item does, then the largest that fits; at most two do,
    then the largest alone if it is as large as the best pair, or the best pair if it holds that largest item and no two items that lie
    between the pair fit as well."""
    others = left.copy()
    others[big] -= 1
    room = capacity - big
    present = np.flatnonzero(others[: room + 1])
    if not len(present):
        return int(left[big]) if not others[big] or big > room else 1, {big: 1}
    top, small = int(present[-1]), present[:3].repeat(np.minimum(others[present[:3]], 3))[:3]

    def times(content: dict[int, int], spare: int = 0) -> tuple[int, dict[int, int]]:
        return max(1, min(int(left[s]) // c for s, c in content.items()) - spare), content

    def with_big(*sizes: int) -> dict[int, int]:
        content = {big: 1}
        for s in sizes:
            content[s] = content.get(s, 0) + 1
        return content

    if len(small) < 2 or small[0] + small[1] > room:
        return times(with_big(top))
    if len(small) == 3 and small.sum() <= room:
        return None  # three may fit: not a case of the procedure
    # the best pair: for each size the largest partner that fits beside it
    at = np.searchsorted(present, room - present, "right") - 1
    at = np.minimum(at, np.arange(len(present)))  # partner no larger than the size itself
    own = (at == np.arange(len(present))) & (others[present] < 2)
    at = np.where(own, at - 1, at)
    sums = np.where(at >= 0, present + present[np.maximum(at, 0)], 0)
    best = int(sums.argmax()) if sums.max() else -1
    pair = (int(present[best]), int(present[at[best]])) if best >= 0 else (0, 0)
    if top >= sum(pair):
        return times(with_big(top))
    holds = np.flatnonzero(sums == sums.max())
    pair = next(((int(present[i]), int(present[at[i]])) for i in holds if present[i] == top), None)
    if pair is None:
        return None
    between = [s for s in range(top - 1, pair[1], -1) if others[s]][-2:]  # the two sizes next above the smaller of the pair
    n_between = int(others[pair[1] + 1 : top].sum()) if top > pair[1] else 0
    if n_between <= 1:
        return times(with_big(*pair), 3)
    two = np.array(between[::-1]).repeat([min(2, int(others[s])) for s in between[::-1]])[:2]
    return times(with_big(*pair), 3) if two.sum() > room else None


def least_containers(counts: np.ndarray, capacity: int) -> int:
    """Lower bound: over every threshold t, items above capacity - t need a container each, as do those over half, and the others down to t fill what these leave."""
    sizes, cum, weight = np.arange(capacity + 1), np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    best = -(-int((counts * sizes).sum()) // capacity)
    for t in range(0, capacity // 2 + 1):
        large = int(cum[capacity] - cum[capacity - t])
        half = int(cum[capacity - t] - cum[capacity // 2])
        half_weight = int(weight[capacity - t] - weight[capacity // 2])
        low = int(weight[capacity // 2] - (weight[t - 1] if t else 0))
        best = max(best, large + half + max(0, -(-(low - (half * capacity - half_weight)) // capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best fit, largest first, on a histogram: containers with equal content are one entry throughout."""
    groups: dict[tuple[tuple[int, int], ...], int] = {}
    by_room: dict[int, set[tuple[tuple[int, int], ...]]] = {}

    def put(content: tuple[tuple[int, int], ...], room: int, times: int) -> None:
        groups[content] = groups.get(content, 0) + times
        by_room.setdefault(room, set()).add(content)

    def take(content: tuple[tuple[int, int], ...], room: int, times: int) -> None:
        groups[content] -= times
        if not groups[content]:
            del groups[content]
            by_room[room].discard(content)
            if not by_room[room]:
                del by_room[room]

    for s in range(capacity, 0, -1):
        todo = int(counts[s])
        while todo:
            rooms = [r for r in by_room if r >= s]
            if rooms:
                room = min(rooms)
                content = min(by_room[room])
                have = groups[content]
                each = min(room // s, todo)
                times = min(have, todo // each)
                take(content, room, times)
                put((*content, (s, each)), room - each * s, times)
                todo -= each * times
            else:
                each = min(capacity // s, todo)
                times = todo // each
                put(((s, each),), capacity - each * s, times)
                todo -= each * times
    return [(n, dict(c)) for c, n in groups.items()]


def plan_of(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def packed(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """``container_id``, ``key``, ``part``, ``token_from``, ``token_to``, ``n_tokens``; every token of every text is in one row."""
    measured = sizes(df, key, text, vocabulary)
    # parts of a document: whole containers, then the rest; ``place`` tells repeated ids apart
    part = F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {capacity} as int)")))
    parts = measured.where("n > 0").select("key", "n", F.monotonically_increasing_id().alias("place"), part.alias("part"))
    parts = parts.select("key", "place", "part", (F.col("part") * capacity).alias("token_from"), F.least(F.col("n"), (F.col("part") + 1) * capacity).cast("int").alias("token_to"))
    parts = stage(parts.withColumn("size", F.col("token_to") - F.col("token_from")).withColumn("bucket", F.pmod(F.xxhash64("key", "part"), F.lit(BUCKETS)).cast("int")), "sizes")
    per = parts.groupBy("size", "bucket").agg(F.count("*").alias("c"))
    base = per.select("size", "bucket", (F.sum("c").over(Window.partitionBy("size").orderBy("bucket")) - F.col("c")).alias("base"))
    histogram = parts.groupBy("size").agg(F.count("*").alias("c")).toPandas()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    counts[histogram["size"]] = histogram["c"]
    rows, container, used = [], 0, np.zeros(capacity + 1, np.int64)
    for times, content in plan_of(counts, capacity):
        for s, c in content.items():
            rows.append((s, used[s], container, c))
            used[s] += times * c
        container += times
    rows.sort()
    by = {s: i for i, s in reversed(list(enumerate(r[0] for r in rows)))}
    starts = {s: (np.array([r[1] for r in rows if r[0] == s]), np.array([r[2] for r in rows if r[0] == s]), np.array([r[3] for r in rows if r[0] == s])) for s in by}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            out = np.zeros(len(size), np.int64)
            for s in np.unique(size):
                first, base_, each = starts[int(s)]
                mine = size == s
                at = np.searchsorted(first, rank[mine], "right") - 1
                out[mine] = base_[at] + (rank[mine] - first[at]) // each[at]
            yield pa.RecordBatch.from_arrays([pa.array(out), *(batch.column(i) for i in range(5))], ["container_id", "key", "part", "token_from", "token_to", "n_tokens"])

    place = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("key", "part", "place"))
    ranked = parts.withColumn("k", place).join(base, ["size", "bucket"]).select("key", "part", "token_from", "token_to", "size", (F.col("base") + F.col("k") - 1).alias("rank"))
    return ranked.mapInArrow(deal, "container_id long, key long, part int, token_from int, token_to int, n_tokens int")


def fill(containers: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens, a lower bound of the number of containers and unused room in per cent."""
    histogram = containers.groupBy("n_tokens").agg(F.count("*").alias("c")).toPandas()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    counts[histogram["n_tokens"]] = histogram["c"]
    per = containers.groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("items"))
    one = per.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.sum("items").alias("items"))
    return one.select("containers", "items", "tokens", "fullest", F.lit(least_containers(counts, capacity)).cast("long").alias("least_containers"), F.round(100 - 100 * F.col("tokens") / F.nullif(F.col("containers") * capacity, F.lit(0)), 4).alias("unused_percent"))
