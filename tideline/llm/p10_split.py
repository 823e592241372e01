"""Problem 10: splitting oversized items at natural boundaries.

Method: agglomerative merging. A text is cut into atomic segments at paragraphs, turns (lines), sentences and, where a sentence is too
long, clauses, spaces or tokens. Adjacent segments are held in a heap by the strength of the boundary between them; the weakest
boundary is merged first as long as both sides and the overlap fit the limit, so the boundaries left are the strongest possible.
Each piece but the first begins with the last ``overlap`` tokens of the piece before.

Everything happens within a text, so rows never move: no shuffle, and a text's pieces come out of one pass.

Sizes and pieces are those of the text's consistent form (problem 2): no-break spaces between words would count as tokens of their own.

Cases: null ids, null and empty texts give no pieces; a text within the limit isn't oversized and gives no row; text without any
space is cut between tokens that end whole characters; a piece that has more tokens read alone than as part of its text is cut smaller; repeated rows give repeated pieces; extra columns are ignored; an empty table gives none."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.textforms import consistent
from tideline.llm.tokens import VOCABULARY, Tokens, tokens

LIMIT, OVERLAP = 1024, 64
#: Bytes of a compatibility or composed form for one byte before, at most (Unicode's figure for NFKC in UTF-8).
LONGER = 11
#: Strength of boundaries, the place after the match is the boundary; later patterns only cut what is still too long.
PARAGRAPH, TURN, SENTENCE, CLAUSE, SPACE, TOKEN = 6, 5, 4, 3, 2, 1
_BREAKS = (
    (PARAGRAPH, re.compile(r"\r?\n[ \t]*(?:\r?\n\s*)+")),
    (TURN, re.compile(r"\r?\n")),
    (SENTENCE, re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s)|[。！？]+[”’」』）]*")),
)
_FINER = ((CLAUSE, re.compile(r"[,;:，；：、](?=\s|[一-鿿])")), (SPACE, re.compile(r"(?=\s)")))


def _byte_places(text: str, places: np.ndarray) -> np.ndarray:
    """Byte offsets of character offsets."""
    if text.isascii():
        return places
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    return np.concatenate([[0], np.cumsum(width)])[places]


def boundaries(text: str, starts: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(token index, strength) of the cuts that make atomic segments of at most ``most`` tokens; the ends are not among them."""
    n = len(starts) - 1
    cuts: dict[int, int] = {}

    def add(strength: int, pattern: re.Pattern) -> dict[int, int]:
        ends = np.array([m.end() for m in pattern.finditer(text)], np.int64)
        got: dict[int, int] = {}
        if len(ends):
            places = _byte_places(text, ends)
            at = np.searchsorted(starts, places)
            for i in np.unique(at[(at < n) & (starts[np.minimum(at, n)] == places)]).tolist():
                if 0 < i < n:
                    got[i] = strength
        return got

    for strength, pattern in _BREAKS:
        for i, s in add(strength, pattern).items():
            cuts.setdefault(i, s)
    for strength, pattern in _FINER:
        edges = [0, *sorted(cuts), n]
        long_ = [(a, b) for a, b in zip(edges, edges[1:]) if b - a > most]
        if not long_:
            return sorted(cuts.items())
        finer = sorted(add(strength, pattern).items())
        where = np.array([i for i, _ in finer], np.int64)
        for a, b in long_:
            for i in where[np.searchsorted(where, a, "right") : np.searchsorted(where, b)].tolist():
                cuts.setdefault(i, strength)
    edges = [0, *sorted(cuts), n]
    if any(b - a > most for a, b in zip(edges, edges[1:])):
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        whole = np.ones(n + 1, bool)
        whole[:-1] = (data[starts[:-1]] & 0xC0) != 0x80  # tokens that begin with a whole character
        for a, b in zip(edges, edges[1:]):
            while b - a > most:
                cut = a + most
                while cut > a + 1 and not whole[cut]:
                    cut -= 1
                cuts[cut] = TOKEN
                a = cut
    return sorted(cuts.items())


def spans(text: str, ids: np.ndarray, starts: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(first token, end token, strength of the cut before) of each piece without its overlap."""
    n = len(ids)
    if n <= limit:
        return [(0, n, 0)]
    room = limit - overlap
    cuts = boundaries(text, starts, room)
    edge = [0, *(i for i, _ in cuts), n]
    strength = [0, *(s for _, s in cuts)]
    count = len(edge) - 1
    right, left, alive = list(range(1, count + 1)), list(range(-1, count - 1)), [True] * count
    end = edge[1:]

    def fits(a: int, b: int) -> bool:
        return end[b] - edge[a] + (overlap if a else 0) <= limit

    heap = [(strength[b], end[b] - edge[b - 1], b - 1, b) for b in range(1, count) if fits(b - 1, b)]
    heapq.heapify(heap)
    while heap:
        s, size, a, b = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or right[a] != b or size != end[b] - edge[a]:
            continue  # stale
        alive[b] = False
        end[a] = end[b]
        right[a] = right[b]
        if right[a] < count:
            left[right[a]] = a
            if fits(a, right[a]):
                heapq.heappush(heap, (strength[right[a]], end[right[a]] - edge[a], a, right[a]))
        if left[a] >= 0 and fits(left[a], a):
            heapq.heappush(heap, (strength[a], end[a] - edge[left[a]], left[a], a))
    return [(edge[a], end[a], strength[a]) for a in range(count) if alive[a]]


def pieces_of(text: str, t: Tokens, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, str]]:
    """(number, first token with overlap, end token, boundary strength, text) of each piece; a character that an overlap would cut is left out of its text.

    A piece cut inside a word may have more tokens alone than in its text. Where one then exceeds the limit, all are cut again with
    as much less room, so every piece holds the limit when it is tokenised by itself."""
    data = text.encode("utf-8", "surrogatepass")
    ids = t.ids(text)
    starts = t.starts(ids)
    room = limit
    while True:
        out = []
        for k, (a, b, s) in enumerate(spans(text, ids, starts, room, overlap)):
            first = max(0, a - overlap) if k else a
            out.append((k, first, b, s, data[starts[first] : starts[b]].decode("utf-8", "ignore")))
        over = max(t.count(body) for *_, body in out) - limit if len(out) > 1 else 0
        if over <= 0 or room - over <= 2 * overlap:
            return out
        room -= over


def pieces(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key``, ``piece``, ``token_from``, ``token_to``, ``n_tokens``, ``boundary``, ``text`` of every text over the limit.

    A text has at most as many tokens as bytes, and its consistent form at most ``LONGER`` times its bytes, so short texts are passed
    over without reading them in Python."""
    if not 0 <= 2 * overlap < limit:
        raise ValueError("the overlap must be under half the limit")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokens(vocabulary)
        for pdf in batches:
            out = []
            for k, x in zip(pdf["key"], pdf["text"]):
                x = consistent(x)
                if len(x) * 4 > limit and t.count(x) > limit:
                    out += [(k, i, a, b, b - a, s, body) for i, a, b, s, body in pieces_of(x, t, limit, overlap)]
            yield pd.DataFrame(out, columns=["key", "piece", "token_from", "token_to", "n_tokens", "boundary", "text"])

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where(F.octet_length("text") > limit // LONGER).where("key is not null")
    kind = df.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, piece int, token_from int, token_to int, n_tokens int, boundary int, text string")
