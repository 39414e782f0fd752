"""Token counts by rank-synchronous merging of ragged numpy arrays.

Texts are split into pre-tokens; the distinct ones of a batch are held as one ragged array of symbols. In each round
every sequence finds its own lowest-ranked adjacent pair and merges all its occurrences at once, so that a round costs a
few array passes for the whole batch, and finished sequences leave. What survives is the token count.
"""

from __future__ import annotations

import functools
import json
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gleaner.llm.common import with_columns_from_text
from gleaner.llm.token_pattern import pre_tokens

#: Distinct pre-tokens whose counts a worker remembers; the memory is dropped when it is full.
REMEMBERED = 1_000_000

SCHEMA = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
    ]
)


def printable_bytes() -> dict[int, str]:
    """The usual map of bytes to printable characters of byte-level vocabularies: printable Latin-1 stands for itself,
    the other bytes follow from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class MergeTable:
    """The vocabulary file as arrays: symbol of each byte, and sorted pair keys with their ranks and results."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.size = max(vocab.values()) + 1
        of_byte = printable_bytes()
        self.symbol = np.array([vocab[of_byte[b]] for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        #: Pairs of two bytes hit directly; other keys by binary search over all pairs that start with the left symbol.
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.memory: dict[str, int] = {}

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (a huge one where there is none) and its place in the table."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.iinfo(np.int64).max), at

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Surviving symbols of each non-empty pre-token."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = lengths.copy()
        symbols = self.symbol[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        none = np.iinfo(np.int64).max
        # The rank of the pair that starts at each symbol; the last symbol of a sequence starts none.
        rank, at = self.look_up(symbols[:-1], symbols[1:]) if len(symbols) > 1 else (np.empty(0, np.int64),) * 2
        rank = np.append(rank, none)
        at = np.append(at, 0)
        rank[np.append(owner[1:] != owner[:-1], True)] = none
        while True:
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(owner)))
            active = lowest != none
            out[owner[starts]] = sizes
            if not active.any():
                return out
            if not active.all():  # finished sequences leave
                keep = np.repeat(active, sizes)
                symbols, owner, rank, at = symbols[keep], owner[keep], rank[keep], at[keep]
                lowest, sizes = lowest[active], sizes[active]
            hit = rank == np.repeat(lowest, sizes)
            # Of a run of hits (equal symbols), every second one merges, from the left.
            where = np.flatnonzero(hit)
            if len(where) > 1 and (np.diff(where) == 1).any():
                index = np.arange(len(where))
                fresh = np.append(True, np.diff(where) != 1)
                where = where[(index - np.maximum.accumulate(np.where(fresh, index, 0))) % 2 == 0]
            symbols[where] = self.made[at[where]]
            gone = np.zeros(len(symbols), bool)
            gone[where + 1] = True
            # Pairs that touch a merged symbol are looked up anew: the merged one's, and its left neighbour's.
            kept = ~gone
            place = np.cumsum(kept) - 1
            symbols, owner = symbols[kept], owner[kept]
            rank, at = rank[kept], at[kept]
            merged = place[where]
            stale = np.unique(np.concatenate([merged, merged[merged > 0] - 1]))
            inner = stale[(stale + 1 < len(symbols))]
            inner = inner[owner[inner] == owner[inner + 1]]
            rank[stale] = none
            if len(inner):
                rank[inner], at[inner] = self.look_up(symbols[inner], symbols[inner + 1])

    def tokens(self, texts: list[str]) -> list[int]:
        """Tokens of each text; the strings of added tokens are one token each, as is the library's default."""
        find = pre_tokens
        totals, split = [], []
        for text in texts:
            special = 0
            for string in self.special:
                if string in text:
                    special += text.count(string)
            totals.append(special)
            parts = [text]
            for string in self.special:
                parts = [p for part in parts for p in part.split(string)] if special else parts
            split.append(Counter(piece for part in parts for piece in find(part)))
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        new = list({piece for pieces in split for piece in pieces if piece not in self.memory})
        if new:
            self.memory.update(zip(new, self.counts([p.encode() for p in new]).tolist()))
        known = self.memory
        return [n + sum(known[p] * k for p, k in pieces.items()) for n, pieces in zip(totals, split)]


@functools.lru_cache(maxsize=4)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def count_tokens(df: DataFrame, text: str = "text", vocabulary: str | None = None, limit: int = 512) -> DataFrame:
    """Adds ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of whole texts.

    Null and empty texts have no bytes and tokens; repeated rows are independent; an empty table stays empty; columns
    named like the new ones are replaced. A single pre-token without blanks costs rounds in the number of distinct
    ranks it merges. Memory follows about 4 MB of text and the pre-tokens remembered.
    """
    import public_tokenizers

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")

    def rows_of(texts):
        return [
            (len(t.encode()), n, n > limit) for t, n in zip(texts, merge_table(path).tokens(list(texts)))
        ]

    return with_columns_from_text(df, rows_of, SCHEMA, text)
