"""Vectorised kernels over batches of word sequences: occurrence labels, order sampling, edit bands.

A batch is a flat array of word hashes and row offsets (Arrow's list layout), so nothing here loops over rows in Python
except where a docstring says so."""

from __future__ import annotations

import numpy as np

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values that spreads them evenly."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def row_ids(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def occurrence_labels(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """0 for the first occurrence of a word in its row, 1 for the second, and so on."""
    if len(words) == 0:
        return np.zeros(0, np.int64)
    both = row_ids(offsets).astype(np.uint64) << np.uint64(32) | words
    order = np.argsort(both, kind="stable")
    both = both[order]
    new = np.ones(len(words), bool)
    new[1:] = both[1:] != both[:-1]
    at = np.arange(len(words))
    start = np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty(len(words), np.int64)
    out[order] = at - start
    return out


def order_samples(words: np.ndarray, offsets: np.ndarray, sketches: int, length: int, seed: int, ordered: bool) -> np.ndarray:
    """``sketches`` keys a row. Each is made of the ``length`` occurrence-labelled words with the smallest hashes.

    All words count alike, so the chance that two rows share a key depends on the share of their words in common alone, not on how
    often these words stand elsewhere.

    ordered: the words keep their order in the text, read from the word with the smallest hash round the end of the text to
    the start, so moving a sentence keeps the key but reordering within it does not. Rows shorter than ``length`` use what they have."""
    n = len(offsets) - 1
    out = np.zeros((n, sketches), np.uint64)
    if n == 0 or len(words) == 0:
        return out
    labels = occurrence_labels(words, offsets).astype(np.uint64)
    item = mix(words.astype(np.uint32).astype(np.uint64) | (labels << np.uint64(32)))
    lengths = np.diff(offsets)
    low = 1
    high = 16
    top = int(lengths.max())
    gone = np.iinfo(np.int32).max  # above every rank
    while low <= top:
        rows = np.flatnonzero((lengths >= low) & (lengths <= high))
        step = max(1, 4_000_000 // high)
        for part in (rows[i : i + step] for i in range(0, len(rows), step)):
            at = offsets[part][:, None] + np.arange(high)[None, :]
            there = np.arange(high)[None, :] < lengths[part][:, None]
            at[~there] = 0
            e = item[at]
            for s in range(sketches):
                clock = mix(e + np.uint64((int(_GOLD) * (seed * 1009 + s + 1)) % (1 << 64)))
                rank = (clock >> np.uint64(34)).astype(np.int32)
                rank[~there] = gone
                lane = np.arange(len(part))
                picks = []
                for _ in range(length):
                    i = rank.argmin(1)
                    picks.append(np.where(rank[lane, i] == gone, -1, i))
                    rank[lane, i] = gone
                p = np.stack(picks, 1)
                if ordered and length > 1:
                    turn = np.where(p < 0, 1 << 30, (p - p[:, :1]) % high)
                    p = np.take_along_axis(p, np.argsort(turn, 1, kind="stable"), 1)
                key = np.full(len(part), np.uint64(s + 1))
                for k in range(length):
                    got = np.where(p[:, k] >= 0, e[lane, np.maximum(p[:, k], 0)], np.uint64(0))
                    key = mix(key * _GOLD + got)
                out[part, s] = key
        low, high = high + 1, high + 8 if high < 128 else high * 2  # rows of like length share a table, so little is padding
    return out


def parity_codes(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """56 parities of a row's distinct words (by hash) above a byte of their number, 255 for that many or more.

    Each word that only one of two rows has flips one parity, so the parities that differ never outnumber these words."""
    both = np.unique(row_ids(offsets).astype(np.uint64) << np.uint64(32) | words)
    rows, item = (both >> np.uint64(32)).astype(np.int64), mix((both & np.uint64(0xFFFFFFFF)) + _GOLD)
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    out = np.zeros(len(counts), np.uint64)
    np.bitwise_xor.at(out, rows, np.uint64(1) << (item % np.uint64(56) + np.uint64(8)))
    return (out | np.minimum(counts, 255).astype(np.uint64)).view(np.int64)


def parity_near(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """False only for pairs of `parity_codes` whose word sets can't have similarity ``least``; rows of 255 words or more always pass."""
    x, y = a & 255, b & 255
    differ = np.bitwise_count((a ^ b).view(np.uint64) >> np.uint64(8))
    low, high = np.minimum(x, y), np.maximum(x, y)
    return (high == 255) | ((differ <= (1 - least) / (1 + least) * (x + y) + 1e-9) & (low >= least * high - 1e-9))


def class_counts(words: np.ndarray, offsets: np.ndarray, classes: int) -> np.ndarray:
    """Number of a row's words in each of ``classes`` vocabulary classes; the words of a row must be distinct."""
    n = len(offsets) - 1
    c = (mix(words.astype(np.uint32).astype(np.uint64)) % np.uint64(classes)).astype(np.int64)
    return np.bincount(row_ids(offsets) * classes + c, minlength=n * classes).reshape(n, classes).astype(np.int16)


def banded_distance(a: list[np.ndarray], b: list[np.ndarray], band: int) -> np.ndarray:
    """Edit distance (insert, delete, replace a word) of each pair within a diagonal band; -1 where it leaves the band.

    All pairs advance together, one row of the table at a time."""
    n = len(a)
    out = np.full(n, -1, np.int64)
    if n == 0:
        return out
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    order = np.argsort(np.maximum(la, lb), kind="stable")
    for part in (order[i : i + 2048] for i in range(0, n, 2048)):
        ma, mb = int(la[part].max()), int(lb[part].max())
        A = np.zeros((len(part), ma), np.int64)
        B = np.full((len(part), mb + 2 * band + 1), -1, np.int64)
        for r, k in enumerate(part):
            A[r, : la[k]] = a[k]
            B[r, band : band + lb[k]] = b[k]
        width, big = 2 * band + 1, 1 << 20
        shift = np.arange(width)
        row = np.where(shift >= band, shift - band, big)[None, :].repeat(len(part), 0)  # table row 0: column j = i + shift - band
        done = np.full(len(part), big)
        ends = lb[part] - la[part] + band
        inside = (ends >= 0) & (ends < width)
        zero = (la[part] == 0) & inside
        done[zero] = row[zero, ends[zero]]
        for i in range(1, ma + 1):
            same = B[:, i - 1 : i - 1 + width] == A[:, i - 1 : i] if i - 1 + width <= B.shape[1] else np.pad(B, ((0, 0), (0, width)), constant_values=-1)[:, i - 1 : i - 1 + width] == A[:, i - 1 : i]
            new = np.where(same, row, row + 1)
            up = np.full_like(row, big)
            up[:, :-1] = row[:, 1:] + 1
            new = np.minimum(new, up)
            column = i + shift - band
            new[:, column < 0] = big
            new[:, column == 0] = np.minimum(new[:, column == 0], i)
            new = np.minimum.accumulate(new - shift, 1) + shift  # insertions run along the row
            row = np.minimum(new, big)
            here = (la[part] == i) & inside
            done[here] = row[here, ends[here]]
        out[part] = np.where(done <= band, done, -1)
    return out
