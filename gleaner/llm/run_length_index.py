"""A run-length index of many strings: run-compressed Burrows-Wheeler transform with sampled run ends.

Built from a suffix array (prefix doubling on packed words, in numpy), it keeps the runs of the transform, the text
positions at both ends of each run, and the text. Patterns are streamed through it from right to left, all of them in lock
step: each step extends a match inside a run, or jumps to the nearest run of the wanted byte, above or below, whose sampled
end shares more with the match so far. The result is, for every pattern position, the length and a place of the longest
match (matching statistics).

Every string has an owner; the index also knows, for each place where a window of the given length starts, the smallest
owner of the same window anywhere in the index.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Owner of windows that nobody owns.
NOBODY = np.iinfo(np.int64).max


def _symbols(strings: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes, each one higher (UTF-8 has no 0xFF), of all strings, each followed by a 0; and the strings' lengths."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    out = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8) + np.uint8(1)
    out[np.cumsum(lengths + 1) - 1] = 0
    return out, lengths


class RunLengthIndex:
    def __init__(self, strings: Sequence[bytes], owners: np.ndarray, window: int):
        if window < 8:
            raise ValueError("windows are 8 bytes at least")
        text, lengths = _symbols(strings)
        n = len(text)
        ends = np.cumsum(lengths + 1) - 1
        left = np.repeat(ends, lengths + 1) - np.arange(n)  # symbols before the separator
        self.words = _packed(text, left)
        suffixes, windows = _suffix_array(self.words, left, window)
        self.n, self.window = n, window
        self.owner_at = _owners(suffixes, windows, left, np.repeat(owners, lengths + 1), window)
        before = text[suffixes - 1]  # of the first string: the last separator
        first = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        end = np.append(first[1:], n)
        head = before[first].astype(np.int64)
        order = np.argsort(before[first], kind="stable")  # by byte, then by row
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        #: Run that holds each row.
        self.run_at = np.repeat(number, end - first)
        head, first, end = head[order], first[order], end[order]
        sizes = end - first
        total = np.cumsum(sizes) - sizes
        #: Row to which the first row of a run leads: in this order, the rows of all runs before are just those of smaller
        #: bytes and of the same byte further up.
        self.leads = total
        self.head, self.first, self.end = head, first, end
        self.key = head * (n + 1) + first
        self.shift = total - first
        self.at_first, self.at_last = suffixes[first], suffixes[end - 1]
        self.start = int(suffixes[0])

    def matching_statistics(self, patterns: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Length and place of the longest match at every position, of all patterns one after the other."""
        symbols, lengths = _symbols(patterns)
        offsets = np.cumsum(lengths + 1) - (lengths + 1)
        out_length = np.zeros(len(symbols), np.int64)
        out_place = np.zeros(len(symbols), np.int64)
        order = np.argsort(-lengths, kind="stable")
        last = (offsets + lengths - 1)[order]  # longest first, so that those still running are a prefix
        ordered = lengths[order]
        row = np.zeros(len(patterns), np.int64)
        place = np.full(len(patterns), self.start, np.int64)
        length = np.zeros(len(patterns), np.int64)
        for step in range(int(ordered[0]) if len(ordered) else 0):
            running = int(np.searchsorted(-ordered, -step, side="left"))
            at = last[:running] - step
            row, place, length = self._extend(symbols[at].astype(np.int64), row[:running], place[:running], length[:running])
            out_length[at] = length
            out_place[at] = place
        inner = symbols != 0
        return out_length[inner], out_place[inner]

    def _extend(self, byte, row, place, length):
        run = self.run_at[row]
        new_row = row + self.shift[run]
        new_place, new_length = place - 1, length + 1
        out = np.flatnonzero(self.head[run] != byte)
        if len(out):
            # The rows that another byte stands before: its nearest runs above and below.
            up = np.searchsorted(self.key, byte[out] * (self.n + 1) + row[out], side="right") - 1
            down = np.minimum(up + 1, len(self.head) - 1)
            has_up, has_down = (up >= 0) & (self.head[up] == byte[out]), self.head[down] == byte[out]
            shared_up = np.where(has_up, self._shared(place[out], self.at_last[up], length[out]), -1)
            shared_down = np.where(has_down, self._shared(place[out], self.at_first[down], length[out]), -1)
            upward = shared_up >= shared_down
            target = np.where(upward, up, down)
            landing = np.where(upward, self.end[up] - 1, self.first[down])
            none = ~(has_up | has_down)  # the byte isn't in the index
            new_row[out] = np.where(none, 0, self.leads[target] + landing - self.first[target])
            new_place[out] = np.where(none, self.start, np.where(upward, self.at_last[up], self.at_first[down]) - 1)
            new_length[out] = np.where(none, 0, np.maximum(shared_up, shared_down) + 1)
        return new_row, new_place, new_length

    def _shared(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Symbols that the text shares from places ``a`` and ``b`` on, at most ``limit``."""
        found = np.zeros(len(a), np.int64)
        going = np.flatnonzero(limit > 0)
        top = self.n - 1
        while len(going):
            x = self.words[np.minimum(a[going] + found[going], top)] ^ self.words[np.minimum(b[going] + found[going], top)]
            equal = np.zeros(len(going), np.int64)
            for i in range(1, 9):
                equal += x >> np.uint64(64 - 8 * i) == 0
            found[going] += equal
            going = going[(equal == 8) & (found[going] < limit[going])]
        return np.minimum(found, limit)

    def window_owners(self, patterns: Sequence[bytes]) -> np.ndarray:
        """For every pattern position, all patterns one after the other: the smallest owner in the index of the window
        that starts there, ``NOBODY`` where it has none (or the pattern ends before)."""
        length, place = self.matching_statistics(patterns)
        return np.where(length >= self.window, self.owner_at[place], NOBODY)


def _packed(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight symbols from each place on, big-endian, zero after a separator."""
    padded = np.append(text, np.zeros(8, np.uint8))
    words = np.zeros(len(text), np.uint64)
    for i in range(8):
        words = words << np.uint64(8) | padded[i : i + len(text)]
    short = np.flatnonzero(left < 8)
    keep = (8 * left[short]).astype(np.uint64)
    words[short] &= np.where(keep == 0, np.uint64(0), ~np.uint64(0) << (np.uint64(64) - np.maximum(keep, np.uint64(1))))
    return words


def _suffix_array(words: np.ndarray, left: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes up to their separator in order (ties by place), and the ranks by the largest power of two of symbols
    within ``window``."""
    n = len(words)
    order = np.argsort(words)
    ordered = words[order]
    fresh = np.append(True, ordered[1:] != ordered[:-1])
    starts = np.flatnonzero(fresh)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    sizes = np.diff(np.append(starts, n))
    open_ = order[np.repeat(sizes > 1, sizes)]
    reached, kept = 8, None
    while True:
        if kept is None and 2 * reached > window:
            kept = rank.copy()
        if not len(open_):
            break
        # Suffixes that ended before are ties, and stand by place; the others go on with what follows.
        then = np.where(left[open_] < reached, open_, rank[np.minimum(open_ + reached, n - 1)])
        key = rank[open_] << np.int64(32) | then
        by = np.argsort(key)
        open_, key = open_[by], key[by]
        group = key >> np.int64(32)
        new_group = np.append(True, group[1:] != group[:-1])
        new_key = np.append(True, key[1:] != key[:-1])
        index = np.arange(len(key))
        within = np.maximum.accumulate(np.where(new_key, index, 0)) - np.maximum.accumulate(np.where(new_group, index, 0))
        rank[open_] = group + within
        firsts = np.flatnonzero(new_key)
        sizes = np.diff(np.append(firsts, len(key)))
        open_ = open_[np.repeat(sizes > 1, sizes)]
        reached *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes, rank if kept is None else kept


def _owners(suffixes, ranks, left, owner, window) -> np.ndarray:
    """Smallest owner of the window at each place: equal windows stand together in suffix order."""
    power = 1 << (window.bit_length() - 1)
    whole = left[suffixes] >= window
    head = ranks[suffixes]
    tail = ranks[np.minimum(suffixes + window - power, len(ranks) - 1)]
    same = whole[1:] & whole[:-1] & (head[1:] == head[:-1]) & (tail[1:] == tail[:-1])
    starts = np.flatnonzero(np.append(True, ~same))
    least = np.minimum.reduceat(owner[suffixes], starts)
    out = np.empty(len(suffixes), np.int64)
    out[suffixes] = np.where(whole, np.repeat(least, np.diff(np.append(starts, len(suffixes)))), NOBODY)
    return out
