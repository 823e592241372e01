"""A compressed full-text index over word sequences: run-length BWT with sampled suffix array, searched backwards in batches."""

from __future__ import annotations

import numpy as np


class WordIndex:
    """Index of a collection of word sequences. Memory: a few words a run of the BWT plus 1/``rate`` of the suffix array.

    ``search`` narrows intervals by one word to the left for many patterns at once; ``locate`` turns intervals into
    (pattern, text, position) by walking at most ``rate`` steps to a sampled entry."""

    def __init__(self, texts: list[np.ndarray], rate: int = 8):
        self.rate = rate
        lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        n = int(self.starts[-1])
        flat = np.concatenate([np.concatenate([t, [0]]) for t in texts]) if texts else np.zeros(0, np.int64)
        body = np.ones(n, bool)
        body[self.starts[1:] - 1] = False
        self.vocabulary, code = np.unique(flat[body], return_inverse=True)
        s = np.zeros(n, np.int64)
        s[body] = code + 1  # 0 ends a text
        sa = self._suffix_array(s)
        bwt = s[sa - 1]
        self.n = n
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=len(self.vocabulary) + 1))])
        change = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]]) if n else np.zeros(0, np.int64)
        symbol, length = bwt[change], np.diff(np.r_[change, n])
        order = np.lexsort((change, symbol))
        self.run_symbol, self.run_start, self.run_length = symbol[order], change[order], length[order]
        total = np.cumsum(self.run_length) - self.run_length
        first = np.r_[True, self.run_symbol[1:] != self.run_symbol[:-1]] if n else np.zeros(0, bool)
        self.run_rank = total - np.maximum.accumulate(np.where(first, total, 0)) if n else total
        self.run_key = self.run_symbol * (n + 1) + self.run_start
        self.flat_start, self.flat_symbol = change, symbol
        kept = np.flatnonzero(sa % rate == 0)
        self.sample_at, self.sample = kept, sa[kept]
        heads = np.flatnonzero(np.isin(sa, self.starts[:-1]))
        self.text_start_at, self.text_starts = heads, sa[heads]

    @staticmethod
    def _suffix_array(s: np.ndarray) -> np.ndarray:
        """Prefix doubling; a text's end ranks by position, so no comparison runs past it."""
        n = len(s)
        ends = s == 0
        key = s + ends.sum()
        key[ends] = np.arange(int(ends.sum()))
        _, rank = np.unique(key, return_inverse=True)
        k = 1
        while n and rank.max() < n - 1:
            second = np.full(n, -1, np.int64)
            second[:-k] = rank[k:]
            both = rank * (n + 1) + second + 1
            _, rank = np.unique(both, return_inverse=True)
            k *= 2
        sa = np.empty(n, np.int64)
        sa[rank] = np.arange(n)
        return sa

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Codes of words, -1 where no text has the word."""
        if not len(self.vocabulary):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, -1)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before position i of the BWT."""
        at = np.searchsorted(self.run_key, symbol * (self.n + 1) + i, side="left") - 1
        got = np.maximum(at, 0)
        mine = (at >= 0) & (self.run_symbol[got] == symbol)
        return np.where(mine, self.run_rank[got] + np.minimum(i - self.run_start[got], self.run_length[got]), 0)

    def search(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the interval of (word + pattern) from the interval of pattern; empty where low == high."""
        none = code < 0
        c = np.where(none, 0, code)
        lo, hi = self.before[c] + self.rank(c, low), self.before[c] + self.rank(c, high)
        return np.where(none, 0, lo), np.where(none, 0, hi)

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which interval, text number, word of the text where the match starts) of every entry of the intervals."""
        size = high - low
        which = np.repeat(np.arange(len(low)), size)
        if not len(which):
            return which, which, which
        at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        steps, position = np.zeros(len(at), np.int64), np.full(len(at), -1, np.int64)
        live = np.arange(len(at))
        while len(live):
            hit = np.minimum(np.searchsorted(self.sample_at, at[live]), len(self.sample_at) - 1)
            found = self.sample_at[hit] == at[live]
            position[live[found]] = self.sample[hit[found]] + steps[live[found]]
            live = live[~found]
            if not len(live):
                break
            run = np.searchsorted(self.flat_start, at[live], side="right") - 1
            symbol = self.flat_symbol[run]
            stop = symbol == 0  # before a text's first word: its start
            if stop.any():
                ends = live[stop]
                # the entry is the start of a text; the n-th end symbol in the BWT belongs to the text whose suffix starts here
                position[ends] = self._start_of(at[ends]) + steps[ends]
                live, symbol = live[~stop], symbol[~stop]
            at[live] = self.before[symbol] + self.rank(symbol, at[live])
            steps[live] += 1
        text = np.searchsorted(self.starts, position, side="right") - 1
        return which, text, position - self.starts[text]

    def _start_of(self, at: np.ndarray) -> np.ndarray:
        return self.text_starts[np.searchsorted(self.text_start_at, at)]


def extend(a: np.ndarray, a_low: np.ndarray, a_high: np.ndarray, b: np.ndarray, b_low: np.ndarray, b_high: np.ndarray, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal matches around equal words ``a[at] == b[to]``: (first, end) in ``a``; a match stays within [low, high) on either side."""
    out = []
    for step in (-1, 1):
        size = np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        while len(live):
            i, j = at[live] + step * (size[live] + 1), to[live] + step * (size[live] + 1)
            ok = (i >= a_low[live]) & (j >= b_low[live]) if step < 0 else (i < a_high[live]) & (j < b_high[live])
            live, i, j = live[ok], i[ok], j[ok]
            live = live[a[i] == b[j]]
            size[live] += 1
        out.append(size)
    return at - out[0], at + out[1] + 1
