"""License scan: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser evaluates expressions.

Phrases are found in the words of a text joined by single blanks, so any punctuation or line break between words is
allowed; identifier tags are found in the text itself, since the expression after a tag needs its punctuation.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Mapping

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gleaner.llm.common import ASCII_LOWER, WORD, with_columns_from_text

#: Phrases whose places are counted, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases, as words, with their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "creative commons": "cc",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
#: Tags that an expression follows, up to the end of the line.
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Families of identifiers by prefix, with their label and how freely their texts may be reused.
FAMILIES = {
    "mit": ("mit", 1.0),
    "apache": ("apache", 1.0),
    "bsd": ("bsd", 1.0),
    "isc": ("isc", 1.0),
    "cc0": ("public-domain", 1.0),
    "unlicense": ("public-domain", 1.0),
    "cc-by": ("cc", 0.8),
    "mpl": ("mpl", 0.6),
    "epl": ("epl", 0.6),
    "lgpl": ("lgpl", 0.5),
    "agpl": ("agpl", 0.1),
    "gpl": ("gpl", 0.2),
}
#: Freedom of a license nobody knows, and what an exception adds to its license.
UNKNOWN, EXCEPTION = 0.3, 0.3
#: Confidence in one notice phrase, one base phrase and one tag with a readable expression.
NOTICE_WEIGHT, BASE_WEIGHT, TAG_WEIGHT = 0.6, 0.7, 0.9

_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_LEXEME = re.compile(r"[a-z0-9.+:_-]+|[()]")
_WORD = re.compile(WORD)

SCHEMA = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("freedom", T.DoubleType()),
    ]
)


def family(identifier: str) -> tuple[str, float]:
    """Label and freedom of an identifier: of the longest family prefix that ends at a separator."""
    parts = re.split(r"(?<=[^-])-(?=\w)", identifier.rstrip("+"))
    for n in range(len(parts), 0, -1):
        found = FAMILIES.get("-".join(parts[:n]))
        if found:
            return found
    return identifier, UNKNOWN


def expression(lexemes: Iterable[str]) -> list[str]:
    """The longest start of ``lexemes`` that is a well-formed expression. Reading stops at the first lexeme that can't
    continue one, so what stands after it costs nothing."""
    read: list[str] = []
    whole = depth = 0
    operand_next = True
    for lexeme in lexemes:
        if operand_next:
            if lexeme in _PRECEDENCE or lexeme == ")":
                break
            depth += lexeme == "("
            operand_next = lexeme == "("
        elif lexeme == ")":
            if not depth:
                break
            depth -= 1
        elif lexeme in _PRECEDENCE:
            operand_next = True
        else:
            break
        read.append(lexeme)
        if not operand_next and not depth:
            whole = len(read)
    return read[:whole]


def evaluate(text: str, start: int = 0, end: int | None = None) -> tuple[frozenset[str], float] | None:
    """Labels of the license expression at the start of a part of a text, and how freely it lets one reuse (or: the
    freest, and: the least, with: an exception frees its license somewhat); None unless there is one.

    Shunting-yard over identifiers, ``and``/``or``/``with`` and brackets; ``with`` binds closest, ``or`` loosest. What
    follows the expression on its line is prose. Takes time in the length of the expression.
    """
    found = _LEXEME.finditer(text, start, len(text) if end is None else end)
    output: list[tuple[set[str], float]] = []
    operators: list[str] = []

    def apply() -> None:
        operator = operators.pop()
        right, left = output.pop(), output.pop()
        if operator == "with":
            output.append((left[0], min(1.0, left[1] + EXCEPTION)))
            return
        more, fewer = (left[0], right[0]) if len(left[0]) >= len(right[0]) else (right[0], left[0])
        more |= fewer
        output.append((more, (max if operator == "or" else min)(left[1], right[1])))

    for lexeme in expression(m.group() for m in found):
        if lexeme == "(":
            operators.append(lexeme)
        elif lexeme == ")":
            while operators[-1] != "(":
                apply()
            operators.pop()
        elif lexeme in _PRECEDENCE:
            while operators and operators[-1] != "(" and _PRECEDENCE[operators[-1]] >= _PRECEDENCE[lexeme]:
                apply()
            operators.append(lexeme)
        else:
            label, freedom = family(lexeme)
            output.append(({label}, freedom))
    while operators:
        apply()
    return (frozenset(output[0][0]), output[0][1]) if output else None


class Scanner:
    def __init__(self, base: Mapping[str, str], notices: Mapping[str, str], tags: tuple[str, ...]):
        self.phrases = ahocorasick.Automaton()
        merged: dict[str, list[tuple[str, bool]]] = {}
        for group, is_base in ((base, True), (notices, False)):
            for phrase, label in group.items():
                merged.setdefault(f" {phrase} ", []).append((label, is_base))
        for phrase, labels in merged.items():
            self.phrases.add_word(phrase, (len(phrase), labels))
        self.phrases.make_automaton()
        self.tags = ahocorasick.Automaton()
        for tag in tags:
            self.tags.add_word(tag, len(tag))
        self.tags.make_automaton()

    def scan(self, text: str) -> tuple:
        lower = text.translate(ASCII_LOWER)
        words = _WORD.findall(lower)
        joined = f" {' '.join(words)} "
        starts: list[int] = []
        base_labels: set[str] = set()
        labels: set[str] = set()
        doubt = 1.0
        for end, (length, found) in self.phrases.iter(joined):
            for label, is_base in found:
                labels.add(label)
                if is_base:
                    starts.append(end - length + 1)
                    base_labels.add(label)
                doubt *= 1 - (BASE_WEIGHT if is_base else NOTICE_WEIGHT)
        freedom = None
        line_end = -1
        for end, _ in self.tags.iter(lower):
            if line_end <= end:
                line_end = lower.find("\n", end + 1)
                line_end = len(lower) if line_end < 0 else line_end
            value = evaluate(lower, end + 1, line_end)
            if value is not None:
                labels |= value[0]
                freedom = value[1] if freedom is None else min(freedom, value[1])
                doubt *= 1 - TAG_WEIGHT
        first = last = None
        if starts:
            # The number of a word is the number of blanks before the one that opens its phrase.
            blanks = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
            first, last = (int(np.searchsorted(blanks, at)) for at in (min(starts), max(starts)))
        return (
            len(words),
            len(starts),
            first,
            last,
            ",".join(sorted(base_labels)),
            ",".join(sorted(labels)),
            1 - doubt,
            freedom,
        )


@functools.lru_cache(maxsize=4)
def scanner(base: tuple, notices: tuple, tags: tuple[str, ...]) -> Scanner:
    return Scanner(dict(base), dict(notices), tags)


def scan(
    df: DataFrame,
    text: str = "text",
    base: Mapping[str, str] = BASE,
    notices: Mapping[str, str] = NOTICES,
    tags: tuple[str, ...] = TAGS,
) -> DataFrame:
    """Adds what licenses a whole text names: word count, places of the base phrases (``n_base``, first and last word),
    ``base_labels``, all ``labels``, ``score`` (confidence that a license is stated: 1 less the product of the doubts
    that each finding leaves) and ``freedom`` (the least of its expressions; null without one).

    Null and empty texts have no words, no labels (empty strings) and score 0; phrases may overlap and each place
    counts; repeated rows are independent; an empty table stays empty; clashing columns are replaced.
    """
    settings = (tuple(base.items()), tuple(notices.items()), tuple(tags))

    def rows_of(texts):
        return map(scanner(*settings).scan, texts)

    return with_columns_from_text(df, rows_of, SCHEMA, text)
