"""The transcript fold: how one more recogniser result changes the text of a capture.

Two texts are compared on their *keys*: the characters that matter, folded, each with the place in the shown text where
it ends. Everything the fold decides (equal, contained, overlapping, revised) is read off the two key strings, in time
linear in their length, and cut positions come from the places.

``merge_transcript`` states the rule for two texts. ``Transcript`` folds a long series of results by the same rule, but
holds key, places and borders as growing arrays and the text as pieces, so that a step costs the new result alone.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

from gleaner import lexicons as lx

_IGNORED = re.compile(rf"[\s　﻿]|{lx.COMPARISON_PUNCTUATION}")
_RUN_OF_BLANKS = re.compile(r"[\s　﻿]+")
_RUN_OF_ASKS, _RUN_OF_CRIES = re.compile(r"[？?]{2,}"), re.compile(r"[！!]{2,}")
_CUE = re.compile(lx.QUESTION_CUE)
_ASKS, _MARKS = ("?", "？"), ("?", "？", "!", "！")
_CRIES = ("!", "！")
_WIDE = str.maketrans(",?!", "，？！")
#: Keys of half a text that count as a sentence said twice.
_HALF = 4


@lru_cache(maxsize=8192)
def _key(character: str) -> str:
    """What a single character adds to the key: nothing for blanks and punctuation."""
    return _IGNORED.sub("", unicodedata.normalize("NFKC", character).lower())


@dataclass(frozen=True)
class Keyed:
    """A shown text with its key and, for every key character, the place after the shown character it came from."""

    shown: str
    key: str
    places: tuple[int, ...]

    @classmethod
    def of(cls, shown: str) -> Keyed:
        keys, places = [], []
        for place, character in enumerate(shown, 1):
            if key := _key(character):
                keys.append(key)
                places.extend([place] * len(key))
        return cls(shown, "".join(keys), tuple(places))

    def rest(self, n: int) -> str:
        """The shown text after the character that holds key character ``n``."""
        return self.shown[self.places[n - 1] :].lstrip() if n else self.shown


def borders(pattern: str) -> list[int]:
    """For every prefix of ``pattern``, the length of its longest proper border."""
    out = [0] * len(pattern)
    width = 0
    for i in range(1, len(pattern)):
        while width and pattern[i] != pattern[width]:
            width = out[width - 1]
        width += pattern[i] == pattern[width]
        out[i] = width
    return out


def overlap(left: str, right: str) -> int:
    """Length of the longest end of ``left`` that ``right`` starts with."""
    tail = left[len(left) - min(len(left), len(right)) :]
    table = borders(right)
    width = 0
    for character in tail:
        while width and (width == len(right) or character != right[width]):
            width = table[width - 1]
        width += width < len(right) and character == right[width]
    return width


def comparison_form(text: str) -> str:
    return Keyed.of(text).key


def collapse_doubled(text: str) -> str:
    """A text that says the same sentence twice, reduced to one with its closing mark."""
    whole = text.strip()
    keyed = Keyed.of(whole)
    half, odd = divmod(len(keyed.key), 2)
    if odd or half < _HALF or keyed.key[:half] != keyed.key[half:] or keyed.places[half - 1] == keyed.places[half]:
        return whole
    first, second = whole[: keyed.places[half - 1]].strip(), whole[keyed.places[half - 1] :].strip()
    if second.endswith(_MARKS) and not first.endswith(_MARKS):
        return first + second[-1]
    return first


def has_han(text: str) -> bool:
    return any("㐀" <= c <= "鿿" for c in text)


def display_form(text: str) -> str:
    shown = _RUN_OF_BLANKS.sub(" ", unicodedata.normalize("NFKC", text)).strip()
    if has_han(shown):
        shown = shown.translate(_WIDE)
    return collapse_doubled(_RUN_OF_CRIES.sub("！", _RUN_OF_ASKS.sub("？", shown)))


def merge_transcript(previous: str, incoming: str) -> str:
    """Fold one result into the text so far.

    Of two texts that say the same, or of which one begins with the other, the fuller one stays. Otherwise the new text
    is appended without what the old one already ends with; a question that starts like the old text and then differs is
    a revision, of which only the part after the common start is appended.
    """
    old, new = Keyed.of(display_form(previous or "")), Keyed.of(display_form(incoming or ""))
    common = next((i for i, (x, y) in enumerate(zip(old.key, new.key)) if x != y), min(len(old.key), len(new.key)))
    if common == len(new.key) < len(old.key) or not new.key:
        return old.shown
    if common == len(old.key) < len(new.key):
        return new.shown
    if common == len(old.key) == len(new.key):
        gains = new.shown.endswith(_ASKS) and not old.shown.endswith(_ASKS)
        return new.shown if gains or len(new.shown) > len(old.shown) else old.shown
    known = overlap(old.key, new.key)
    if not known and common >= 2 and _CUE.search(new.shown):
        known = common
    return display_form(old.shown + new.rest(known))


class Transcript:
    """A text that grows by ``merge``, step for step the same as ``merge_transcript``.

    A result is compared with the first and the last characters of the key only, as many as it has itself. A text said
    twice shows in the border table: its smallest period divides half its length. The whole text is read again only when
    it shrinks to half, when a result replaces it, when the first Han character arrives, or when a result begins with a
    character that combines with the one before.
    """

    __slots__ = ("pieces", "key", "places", "border", "length", "han", "settled", "wide_mark")

    def __init__(self, pieces: Iterable[str] = (), settled: bool = False, wide_mark: int = -1):
        self._hold([p for p in pieces if p])
        #: Whether the display form of the text is the text itself, but for ``wide_mark``.
        self.settled = settled
        #: The piece whose last character became wide because it met another mark; the next step narrows it again.
        self.wide_mark = wide_mark

    def _hold(self, pieces: list[str]) -> None:
        self.pieces, self.key, self.places, self.border = [], [], array("q"), array("q")
        self.length, self.han = 0, False
        for piece in pieces:
            self._append(piece)

    def _append(self, piece: str) -> None:
        """Add a piece, its key, and the border of every longer prefix of the key."""
        keyed = Keyed.of(piece)
        key, border = self.key, self.border
        for character, place in zip(keyed.key, keyed.places):
            width = border[-1] if border else 0
            while width and character != key[width]:
                width = border[width - 1]
            border.append(width + 1 if key and character == key[width] else 0)
            key.append(character)
            self.places.append(self.length + place)
        self.pieces.append(piece)
        self.length += len(piece)
        self.han = self.han or has_han(piece)

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def _replace(self, shown: str, settled: bool) -> None:
        self._hold([shown] if shown else [])
        self.settled, self.wide_mark = settled, -1

    def _doubled(self) -> bool:
        half, odd = divmod(len(self.key), 2)
        if odd or half < _HALF or half % (len(self.key) - self.border[-1]):
            return False
        return self.places[half - 1] != self.places[half]

    def _settle(self) -> None:
        """Bring the text to its display form, as the start of a step does."""
        if not self.settled:
            self._replace(display_form(self.text), True)
            # Marks that were narrowed or a text that was halved may have more to give.
            self.settled = display_form(self.text) == self.text
            return
        if self.wide_mark >= 0:
            if not self.han:
                piece = self.pieces[self.wide_mark]
                self.pieces[self.wide_mark] = piece[:-1] + unicodedata.normalize("NFKC", piece[-1])
            self.wide_mark = -1
        if self._doubled():
            self._replace(collapse_doubled(self.text), False)

    def merge(self, incoming: str) -> None:
        self._settle()
        new = Keyed.of(display_form(incoming or ""))
        size, known = len(self.key), len(new.key)
        head = self.key[:known]
        common = next((i for i, (x, y) in enumerate(zip(head, new.key)) if x != y), min(size, known))
        if not known or common == known < size:
            return
        if common == size < known:
            self._replace(new.shown, False)
            return
        if common == size == known:
            last = self.pieces[-1] if self.pieces else ""
            gains = new.shown.endswith(_ASKS) and not last.endswith(_ASKS)
            if gains or len(new.shown) > self.length:
                self._replace(new.shown, False)
            return
        shared = overlap("".join(self.key[-known:]), new.key)
        if not shared and common >= 2 and _CUE.search(new.shown):
            shared = common
        self._extend(new.rest(shared))

    def _extend(self, rest: str) -> None:
        """The display form of the text followed by ``rest``."""
        rest = unicodedata.normalize("NFKC", rest)
        if not rest:
            return
        last = self.pieces[-1][-1] if self.pieces else ""
        han = self.han or has_han(rest)
        combines = not unicodedata.is_normalized("NFKC", unicodedata.normalize("NFKC", last) + rest[0])
        if combines or unicodedata.combining(rest[0]) or (han and not self.han):
            self._replace(display_form(self.text + rest), False)
            return
        if han:
            rest = rest.translate(_WIDE)
        for marks, wide in ((_ASKS, _ASKS[1]), (_CRIES, _CRIES[1])):
            if last in marks and rest.startswith(marks):
                self.pieces[-1] = self.pieces[-1][:-1] + wide
                self.wide_mark = len(self.pieces) - 1
                rest = rest.lstrip("".join(marks))
        if rest:
            self._append(rest)
        if self._doubled():
            self._replace(collapse_doubled(self.text), False)
