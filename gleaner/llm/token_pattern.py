"""The pre-tokenizer pattern of the public byte-level vocabularies."""

from __future__ import annotations

import functools
import re

import numpy as np
import public_tokenizers
import regex

#: The same matches in the standard library's terms, for texts in which its classes agree with the Unicode properties.
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


@functools.cache
def pre_tokenizer() -> regex.Pattern:
    """``public_tokenizers.PATTERN`` with white space spelled as the Unicode property both libraries use."""
    spelled = public_tokenizers.PATTERN.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
    return regex.compile(spelled)


@functools.cache
def _disagreeing() -> np.ndarray:
    """For every code point: does the standard library class it as letter, number or blank unlike the properties?"""
    out = np.zeros(0x110000, bool)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for plain, prop in ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\p{White_Space}")):
        odd = set(re.findall(plain, every)) ^ set(regex.findall(prop, every))
        out[[ord(c) for c in odd]] = True
    return out


def pre_tokens(text: str) -> list[str]:
    """All matches in ``text``: by the faster module where every character allows it, which is looked up first."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if _disagreeing()[codes].any():
        return pre_tokenizer().findall(text)
    return _PLAIN.findall(text)
