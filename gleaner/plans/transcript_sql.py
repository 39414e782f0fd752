"""The transcript fold as a SQL expression, for texts that compatibility normalisation leaves as they are and that hold
no Han characters (which is what the given tables hold)."""

from __future__ import annotations

from gleaner import lexicons as lx

_IGNORED = (r"[\s]|" + lx.COMPARISON_PUNCTUATION).replace("'", "''")


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def key(shown: str) -> str:
    return f"lower(regexp_replace({shown}, '{_IGNORED}', '', 'g'))"


def places(shown: str) -> str:
    """Positions of the characters that count."""
    return (
        f"list_filter(range(1, length({shown}) + 1), lambda i_: NOT regexp_full_match(substr({shown}, i_, 1), '{_IGNORED}'))"
    )


def collapse_doubled(shown: str) -> str:
    first, second = "trim(substr(s1, 1, p1[h1]))", "trim(substr(s1, p1[h1] + 1))"
    gains = f"regexp_matches({second}, '[?？!！]$') AND NOT regexp_matches({first}, '[?？!！]$')"
    halved = let("p1", places("s1"), f"CASE WHEN {gains} THEN {first} || right({second}, 1) ELSE {first} END")
    twice = "length(k1) % 2 = 0 AND h1 >= 4 AND left(k1, h1) = right(k1, h1)"
    body = let("k1", key("s1"), let("h1", "length(k1) // 2", f"CASE WHEN {twice} THEN {halved} ELSE s1 END"))
    return let("s1", f"trim({shown})", body)


def display_form(text: str) -> str:
    plain = rf"trim(regexp_replace(replace(replace({text}, '？', '?'), '！', '!'), '\s+', ' ', 'g'))"
    return collapse_doubled(f"regexp_replace(regexp_replace({plain}, '\\?{{2,}}', '？', 'g'), '!{{2,}}', '！', 'g')")


def merge(previous: str, incoming: str) -> str:
    """One step of the fold."""
    common = (
        "coalesce(list_min(list_filter(range(1, least(length(ko), length(kn)) + 1), "
        "lambda i_: substr(ko, i_, 1) <> substr(kn, i_, 1))) - 1, least(length(ko), length(kn)))"
    )
    overlap = (
        "coalesce(list_max(list_filter(range(1, least(length(ko), length(kn)) + 1), "
        "lambda i_: right(ko, i_) = left(kn, i_))), 0)"
    )
    cue = lx.QUESTION_CUE
    known = let("o_", overlap, f"CASE WHEN o_ = 0 AND c_ >= 2 AND regexp_matches(n_, '{cue}') THEN c_ ELSE o_ END")
    rest = f"CASE WHEN w_ = 0 THEN n_ ELSE ltrim(substr(n_, {places('n_')}[w_] + 1)) END"
    gains = "(regexp_matches(n_, '[?？]$') AND NOT regexp_matches(p_, '[?？]$')) OR length(n_) > length(p_)"
    chosen = f"""CASE WHEN kn = '' OR (c_ = length(kn) AND c_ < length(ko)) THEN p_
      WHEN c_ = length(ko) AND c_ < length(kn) THEN n_
      WHEN c_ = length(ko) AND c_ = length(kn) THEN CASE WHEN {gains} THEN n_ ELSE p_ END
      ELSE {let("w_", known, display_form(f"p_ || {rest}"))} END"""
    body = let("ko", key("p_"), let("kn", key("n_"), let("c_", common, chosen)))
    return let("p_", display_form(previous), let("n_", display_form(incoming), body))


def fold(texts: str) -> str:
    """The fold of a list of texts, in order."""
    return f"list_reduce(list_prepend('', {texts}), lambda a_, b_: {merge('a_', 'b_')})"
