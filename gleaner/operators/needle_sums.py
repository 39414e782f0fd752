"""Sums of points over the questions whose needles stand in a section's words, by numpy inside a task.

``Needles`` holds a question table's postings by needle and finds the needles inside words, so that sections, or the postings of
a stored index, can be scored where they are, without moving a posting. ``Flags`` adds up their points by question.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gleaner import lexicons as lx

RULE = "\ufdd4"  # noncharacter in front of needles that are rules, not words
POINTS = ("t", "x", "c", "k", "i", "p")
FLAGS = ("nt", "nx", "nc", "nr", "nr", "nr")
SUMS = ("direct", "technical", "covered", "concept", "intent", "phrase")
#: A needle that at least one question in so many asks for is added up by a matrix product.
OFTEN = 16
#: Cells (section, needle) are held in a dense array if at least one in so many is hit.
FEW = 32
#: Entries of a table by state and byte; a dense array may have 32 times as many.
TABLE = 1 << 18


@dataclass
class Flags:
    """The questions that ask for each needle, with their flags."""

    size: int
    questions: int
    posts: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]
    often: dict[str, tuple[np.ndarray, np.ndarray]]
    rare: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, nid: np.ndarray, place: np.ndarray, flags: dict[str, np.ndarray], size: int, questions: int) -> Flags:
        """From rows of needle, question and flags, of ``size`` needles."""
        posts, often, rare = {}, {}, {}
        for flag, given in flags.items():
            value = given.astype(np.float64)
            used = np.flatnonzero(value)
            used = used[np.argsort(nid[used], kind="stable")]
            asked = np.bincount(nid[used], minlength=size)
            common = np.flatnonzero(asked * OFTEN >= max(1, questions))
            column = np.full(size, -1)
            column[common] = np.arange(len(common))
            dense = column[nid[used]] >= 0
            matrix = np.zeros((len(common), questions))
            np.add.at(matrix, (column[nid[used[dense]]], place[used[dense]]), value[used[dense]])
            often[flag] = common, matrix
            for kept, some in ((posts, used), (rare, used[~dense])):
                kept[flag] = np.searchsorted(nid[some], np.arange(size + 1)), place[some], value[some]
        return cls(size, questions, posts, often, rare)

    def sums(self, place: np.ndarray, points: np.ndarray, lists: np.ndarray, word: np.ndarray, ends: np.ndarray, nids: np.ndarray, n: int) -> np.ndarray:
        """The six sums, ``(6, n, questions)``, of words in lists at ``place`` that have ``points[:, list]``; a word holds the
        needles ``nids[ends[word]:ends[word + 1]]``."""
        out = np.zeros((len(SUMS), n, self.questions))
        for i, flag in enumerate(FLAGS):
            own = np.flatnonzero(points[i][lists])
            if not len(own):
                continue
            row, needle = spread(ends, word[own])
            cell, got = (place[lists[own]] * self.size)[row] + nids[needle], points[i][lists[own]][row]
            common, matrix = self.often[flag]
            # Words that hold a needle add up to the cap; of the other points the highest counts.
            if len(cell) * FEW < n * self.size or n * self.size > TABLE << 5:
                order = np.argsort(cell, kind="stable")
                cell, got = cell[order], got[order]
                starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
                if not len(starts):
                    continue
                cell = cell[starts]
                got = np.minimum(np.add.reduceat(got, starts), lx.TOKEN_CAP) if i == 0 else np.maximum.reduceat(got, starts)
                rest, at, value = self.posts[flag]
            else:
                if i == 0:
                    best = np.minimum(np.bincount(cell, got, n * self.size), lx.TOKEN_CAP)
                else:
                    best = np.zeros(n * self.size)
                    np.maximum.at(best, cell, got)
                grid = best.reshape(n, self.size)
                out[i] = grid[:, common] @ matrix
                grid[:, common] = 0
                cell = np.flatnonzero(best != 0)
                got = best[cell]
                rest, at, value = self.rare[flag]
            section, nid = np.divmod(cell, self.size)
            row, post = spread(rest, nid)
            more = np.bincount((section * self.questions)[row] + at[post], got[row] * value[post], out[i].size)
            out[i] += more.reshape(out[i].shape)
        return out


def spread(ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the slices ``ends[a]:ends[a + 1]`` of all ``at``: the number of the slice and the place, one after the other."""
    sizes = ends[at + 1] - ends[at]
    row = np.repeat(np.arange(len(at)), sizes)
    first = np.repeat(ends[at] - (np.cumsum(sizes) - sizes), sizes)
    return row, np.arange(len(row)) + first


def total(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coverage and the score of six sums. Of highest points it is an upper bound: every part grows with them."""
    coverage = np.where(sums[2] >= lx.TITLE_COVERAGE_MIN, sums[2] * lx.TITLE_COVERAGE_POINTS, 0)
    return coverage, coverage + sums[0] + sums[1] + sums[3] + sums[4] + sums[5]


@dataclass
class Steps:
    """Byte strings as a tree: by depth, the sorted ``state * 256 + byte`` that lead on and the number of the string that ends
    there, or -1. The first depths, where most places are dropped, are tables."""

    keys: list[np.ndarray]
    ends: list[np.ndarray]
    tables: list[np.ndarray | None]

    @classmethod
    def of(cls, strings: list[bytes], numbers: np.ndarray) -> Steps:
        """From distinct strings that are not empty."""
        data, sizes = np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings], np.int64)
        starts, state, open_ = np.cumsum(sizes) - sizes, np.zeros(len(strings), np.int64), np.arange(len(strings))
        keys, ends, tables, before = [], [], [], 1
        while len(open_):
            here, state[open_] = np.unique(state[open_] * 256 + data[starts[open_] + len(keys)], return_inverse=True)
            last = sizes[open_] == len(keys) + 1
            end = np.full(len(here), -1)
            end[state[open_[last]]] = numbers[open_[last]]
            table = None
            if before * 256 <= TABLE:
                table = np.full(before * 256, -1, np.int32)
                table[here] = np.arange(len(here))
            keys, ends, tables, before = [*keys, here], [*ends, end], [*tables, table], len(here)
            open_ = open_[~last]
        return cls(keys, ends, tables)

    def inside(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """``(word, number)`` of the strings that stand in each word, once each, by word. All places step on together."""
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
        place, word = np.arange(offsets[0], offsets[-1]), np.repeat(np.arange(len(words)), np.diff(offsets))
        state, found, base = np.zeros(len(place), np.int64), [np.zeros(0, np.int64)], 1 + max((e.max() for e in self.ends), default=0)
        for keys, ends, table in zip(self.keys, self.ends, self.tables, strict=True):
            key = state * 256 + data[place]
            if table is None:
                state = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                on = np.flatnonzero(keys[state] == key)
            else:
                state = table[key].astype(np.int64)
                on = np.flatnonzero(state >= 0)
            place, word, state = place[on] + 1, word[on], state[on]
            number = ends[state]
            whole = number >= 0
            found.append(word[whole] * base + number[whole])
            on = np.flatnonzero(place < offsets[word + 1])
            place, word, state = place[on], word[on], state[on]
        pairs = np.sort(np.concatenate(found))
        return np.divmod(pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs, base)


@dataclass
class Needles:
    """The postings of a question table, by needle. Small enough to be sent to every executor."""

    steps: Steps
    whole: pa.Array
    whole_ids: np.ndarray
    ids: pa.Array
    flags: Flags

    @classmethod
    def of(cls, postings: pa.Table) -> Needles:
        """From rows ``(query_id, needle, nt, nx, nc, nr)``; rows without needle find nothing."""
        rows = postings.filter(pc.is_valid(postings["needle"])).combine_chunks()
        needle, query = (_coded(rows[c]) for c in ("needle", "query_id"))
        nid, place, ids = needle.indices.to_numpy(), query.indices.to_numpy(), query.dictionary
        names = needle.dictionary.to_pylist()
        # Rules and needles of one character are whole words.
        part = np.array([len(n) > 1 and not n.startswith(RULE) for n in names], bool)
        steps = Steps.of([n.encode() for n, p in zip(names, part) if p], np.flatnonzero(part))
        flags = Flags.of(nid, place, {f: rows[f].to_numpy() for f in dict.fromkeys(FLAGS)}, len(names), len(ids))
        whole = np.flatnonzero(~part)
        return cls(steps, needle.dictionary.cast(pa.large_string()).take(pa.array(whole)), whole, ids, flags)

    def inside(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """``(ends, numbers)``: the numbers of the needles that stand in a word are ``numbers[ends[i]:ends[i + 1]]``."""
        word, nid = self.steps.inside(words)
        free = ~pc.starts_with(words, RULE).to_numpy(zero_copy_only=False)
        word, nid = word[free[word]], nid[free[word]]
        if len(self.whole):
            at = pc.fill_null(pc.index_in(words, value_set=self.whole), -1).to_numpy()
            same = np.flatnonzero(at >= 0)
            word, nid = np.append(word, same), np.append(nid, self.whole_ids[at[same]])
            order = np.argsort(word, kind="stable")
            word, nid = word[order], nid[order]
        return np.searchsorted(word, np.arange(len(words) + 1)), nid

    def scores(self, place: np.ndarray, points: np.ndarray, words: pa.ListArray, n: int) -> np.ndarray:
        """The six sums, ``(6, n, questions)``, of lists of words at ``place`` whose words have ``points[:, list]`` each."""
        lists = np.repeat(np.arange(len(words)), words.value_lengths().fill_null(0).to_numpy())
        # A word that is null holds nothing, like an empty one.
        coded = _coded(words.flatten().fill_null(""))
        if not len(coded) or not self.flags.size or not n:
            return np.zeros((len(SUMS), n, len(self.ids)))
        ends, nids = self.inside(coded.dictionary.cast(pa.large_string()))
        word = coded.indices.to_numpy()
        hit = np.flatnonzero(ends[word + 1] > ends[word])
        return self.flags.sums(place, points, lists[hit], word[hit], ends, nids, n)

    def posted(self, place: np.ndarray, points: np.ndarray, words: pa.Array, at: np.ndarray, n: int) -> np.ndarray:
        """The six sums, ``(6, n, questions)``, of postings at ``place`` with ``points[:, posting]``, each of the word
        ``words[at]``."""
        coded = _coded(words.fill_null(""))
        if not len(coded) or not self.flags.size or not n:
            return np.zeros((len(SUMS), n, len(self.ids)))
        ends, nids = self.inside(coded.dictionary.cast(pa.large_string()))
        word = coded.indices.to_numpy()[at]
        hit = np.flatnonzero(ends[word + 1] > ends[word])
        return self.flags.sums(place, points, hit, word[hit], ends, nids, n)


def _coded(values: pa.Array | pa.ChunkedArray) -> pa.DictionaryArray:
    whole = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return whole.dictionary_encode(null_encoding="encode")
