"""Column helpers for text: Unicode whitespace, trimming, ASCII word edges, ordered rule tables, in-place substitution.

Java's ``\\s`` is ASCII only and its ``\\b`` follows Unicode letters, so patterns that must treat ideographic spaces as
blanks or must find ``RAG`` inside Han text use the explicit classes below.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every Unicode blank, written for use inside a character class.
BLANKS = r"\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: The same set as one regex atom. The Unicode property is tested in one step, where the spelled-out class is several
#: times slower on long texts.
WS = r"(?U:[\s\uFEFF])"
#: The same set as characters, for trimming without a regex.
BLANK_CHARS = (
    " \t\n\x0b\f\r\u00a0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
#: Blanks that do not end a line.
INLINE_WS = r"[ \t\x0B\f\r\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000\uFEFF]"
#: ASCII word edges, usable between a Latin and a Han character.
EDGE_BEFORE = r"(?<![A-Za-z0-9_])"
EDGE_AFTER = r"(?![A-Za-z0-9_])"
#: An ASCII word boundary in general position.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
HAN = r"\u4E00-\u9FFF"

# Unicode noncharacters: never valid in interchanged text, so they are safe as private separators.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times.

    Catalyst inlines an expression at every reference, and inside a lambda it is then evaluated per element; binding
    it to a lambda variable of a one-element array evaluates it once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def trim(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(BLANK_CHARS))


def rtrim(c: Column | str) -> Column:
    return F.rtrim(col(c), F.lit(BLANK_CHARS))


def squeeze(c: Column | str) -> Column:
    """Collapse every blank run to one space and trim.

    The single Unicode property is the fast path; the exact class is used only where a text holds U+0085, which the
    property counts as blank and this data model does not. Single spaces, which stay as they are, are not matched.
    """

    def build(t: Column) -> Column:
        fast = F.regexp_replace(F.replace(t, F.lit("\ufeff"), F.lit(" ")), r"(?U)\s{2,}|[^\S ]", " ")
        exact = F.regexp_replace(t, f"[{BLANKS}]+", " ")
        return trim(F.when(F.contains(t, F.lit("\u0085")), exact).otherwise(fast))

    return let(col(c), build)


def matches(c: Column | str, pattern: str) -> Column:
    return text_or_empty(c).rlike(pattern)


def contains(haystack: Column | str, needle: Column | str) -> Column:
    return F.contains(col(haystack), col(needle))


def clip(c: Column | str, limit: int) -> Column:
    """Trim, then cut at ``limit`` characters and mark the cut with an ellipsis."""
    t = trim(text_or_empty(c))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("…"))).otherwise(t)


def first_rule(c: Column | str, rules: Sequence[tuple[str, str]], default: Column | str | None) -> Column:
    """Label of the first ``(label, pattern)`` that matches; rules are folded into one CASE expression."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    out = None
    for label, pattern in rules:
        hit = matches(c, pattern)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return fallback if out is None else out.otherwise(fallback)


def any_rule(c: Column | str, patterns: Iterable[str]) -> Column:
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | matches(c, pattern)
    return hit


def gated_rewrite(c: Column, pattern: str, replacement: str, require: str | None, veto: str | None) -> Column:
    """Replace ``pattern`` only where the context pattern holds and the veto pattern does not."""
    gate = F.lit(True)
    if require:
        gate = gate & c.rlike(require)
    if veto:
        gate = gate & ~c.rlike(veto)
    return F.when(gate, F.regexp_replace(c, pattern, replacement)).otherwise(c)


def substitute(c: Column, pattern: str, rewrite: Callable[[Column], Column]) -> Column:
    """Rewrite every match of ``pattern`` with a column expression, inside the row.

    Matches are fenced with noncharacters, the text is split on them, and the odd pieces are rewritten. This stays a
    JVM expression and needs neither a Python callback nor a shuffle. The text is bound once, so that chains of rewrites
    stay as long as the sum of their steps.
    """

    def build(t: Column) -> Column:
        parts = F.split(F.regexp_replace(t, f"({pattern})", f"{_OPEN}$1{_CLOSE}"), f"[{_OPEN}{_CLOSE}]")
        return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, rewrite(p)).otherwise(p)), "")

    return let(c, lambda t: F.when(t.rlike(pattern), build(t)).otherwise(t))


def quote(literal: str) -> str:
    return re.escape(literal)
