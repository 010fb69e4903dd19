"""A byte-level BPE vocabulary from its public rank file."""

from __future__ import annotations

import base64
import re

import numpy as np
import tiktoken

# Fixed value: how texts are cut before the merges of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# White space as the pattern has it; longer runs are merged by themselves, as its matching recurses.
_LONG_RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{20000,}")


class ByteCoder:
    """Encodes whole texts; strings of special tokens are ordinary text."""

    def __init__(self, ranks: bytes):
        rows = (line.split() for line in ranks.splitlines() if line)
        self.ranks = {base64.b64decode(a): int(b) for a, b in rows}
        self.most = max(self.ranks.values()) + 1
        self.coder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.sizes = np.zeros(self.most, np.int64)  # bytes that an id covers
        for token, i in self.ranks.items():
            self.sizes[i] = len(token)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int64)
        ids, at = [], 0
        for run in _LONG_RUN.finditer(text):
            # The pattern leaves the last blank of a run to what follows it.
            end = run.end() - (run.end() < len(text))
            ids += self.coder.encode_ordinary(text[at:run.start()])
            ids += self.coder._encode_single_piece(text[run.start():end])
            at = end
        return np.array(ids + self.coder.encode_ordinary(text[at:]), np.int64)
