"""Question features: tokens, synonyms, the generic gate, intent, concepts, terms and retrieval anchors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.functions import text as tx

TECHNICAL_TERM = lx.TECHNICAL_TERM
_TOKEN = r"[\p{L}\p{N}]{2,}"
_HAN_TOKEN = r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]{2,}"
# No Han character lies below the CJK radicals; a range test spares other scripts the slower script lookup.
_MAYBE_HAN = r"[\u2E80-\x{3FFFF}]"
TITLE_TERM = lx.TITLE_TERM


def tokens(text: Column | str, stop: Sequence[str] = lx.STOP_TOKENS) -> Column:
    """Lower-cased tokens: each Han character alone, other runs of letters and digits of two or more characters."""
    lowered = F.lower(tx.text_or_empty(text))
    found = F.when(
        lowered.rlike(_MAYBE_HAN), F.regexp_extract_all(lowered, F.lit(_HAN_TOKEN), 0)
    ).otherwise(F.regexp_extract_all(lowered, F.lit(_TOKEN), 0))
    return F.filter(found, lambda w: ~w.isin(*stop)) if stop else found


def apply_synonyms(query: Column | str, synonyms: Sequence[tuple[str, str]] = lx.SYNONYMS) -> Column:
    out = tx.text_or_empty(query)
    for pattern, replacement in synonyms:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def is_generic(query: Column | str, pattern: str = lx.GENERIC_QUERY) -> Column:
    """Stock phrases that name no subject once blanks and punctuation are gone."""
    return F.regexp_replace(tx.text_or_empty(query), rf"[{tx.BLANKS}，,。！？?!]", "").rlike(pattern)


def answerable(
    questions: DataFrame,
    text: str = "query",
    generic: str = lx.GENERIC_QUERY,
    stop: Sequence[str] = lx.STOP_TOKENS,
) -> DataFrame:
    """Questions that are not generic and have at least one token."""
    return questions.filter(~is_generic(text, generic) & (F.size(tokens(text, stop)) > 0))


def intent(query: Column | str, rules: Sequence[tuple[str, str]] = lx.INTENT_RULES) -> Column:
    return tx.first_rule(query, rules, lx.DEFAULT_INTENT)


def concepts(query: Column | str, groups: Sequence[tuple[str, Sequence[str]]] = lx.CONCEPTS) -> Column:
    """Concepts with at least one variant inside the query, in table order. The table is small and travels as a literal."""
    lowered = F.lower(tx.text_or_empty(query))
    flags = []
    for concept, variants in groups:
        hit = F.lit(False)
        for variant in variants:
            hit = hit | F.contains(lowered, F.lit(variant.lower()))
        flags.append(F.when(hit, F.lit(concept)))
    if not flags:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*flags))


def technical_terms(query: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(tx.text_or_empty(query)), F.lit(TECHNICAL_TERM), 0))


def title_terms(query: Column | str, stop: Sequence[str] = lx.TITLE_STOP_TERMS) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.lower(tx.text_or_empty(query)), F.lit(TITLE_TERM), 0))
    return F.filter(found, lambda t: ~t.isin(*stop)) if stop else found


def anchored_query(query: Column | str, rules: Sequence[tuple[str, str]] = lx.ANCHOR_RULES) -> Column:
    """The query followed by the anchor line of every rule it matches."""
    q = tx.text_or_empty(query)
    return F.concat_ws("\n", q, *[F.when(q.rlike(pattern), F.lit(anchor)) for pattern, anchor in rules])


def question_features(
    questions: DataFrame,
    text: str = "query",
    synonyms: Sequence[tuple[str, str]] = lx.SYNONYMS,
    stop: Sequence[str] = lx.STOP_TOKENS,
    generic: str = lx.GENERIC_QUERY,
    intents: Sequence[tuple[str, str]] = lx.INTENT_RULES,
    groups: Sequence[tuple[str, Sequence[str]]] = lx.CONCEPTS,
) -> DataFrame:
    """Everything scoring needs about a question, computed once per question before any join."""
    rewritten = questions.withColumn(text, apply_synonyms(text, synonyms))
    return answerable(rewritten, text, generic, stop).withColumns(
        {
            "q_tokens": tokens(text, stop),
            "q_intent": intent(text, intents),
            "q_concepts": concepts(text, groups),
            "q_terms": technical_terms(text),
            "q_title_terms": title_terms(text),
        }
    )
