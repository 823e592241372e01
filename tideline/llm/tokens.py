"""Tokens of a public byte-level tokenizer: sizes, and where tokens start in a text's bytes. The vocabulary's path is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the published pattern that goes with byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokens:
    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.length[i] = len(token)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.int64)

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def starts(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token, and of the end."""
        return np.concatenate([[0], np.cumsum(self.length[ids])])


@lru_cache(maxsize=2)
def tokens(path: str = VOCABULARY) -> Tokens:
    """One tokenizer a process; loading takes a fraction of a second."""
    return Tokens(path)
