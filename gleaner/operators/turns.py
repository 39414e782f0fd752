"""Turn features: completeness, follow-ups, confirmed questions, latest question turn, display clean-up."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.functions import text as tx
from gleaner.operators import ordered


def is_follow_up(text: Column | str, patterns: Sequence[str] = lx.FOLLOW_UPS) -> Column:
    return tx.any_rule(_turn_text(text), patterns)


def _turn_text(text: Column | str) -> Column:
    return F.regexp_replace(tx.trim(tx.text_or_empty(text)), r"[。！!]+\z", "")


def classify_turn(
    text: Column | str,
    endings: Sequence[str] = lx.INCOMPLETE_ENDINGS,
    question: str = lx.QUESTION_WORDS,
    follow_ups: Sequence[str] = lx.FOLLOW_UPS,
) -> Column:
    """Struct of ``complete``, ``follow_up`` and the silence ``delay_ms`` after which the turn may be committed."""
    t = _turn_text(text)
    follow = tx.any_rule(t, follow_ups)
    incomplete = F.lit(False)
    for ending in endings:
        incomplete = incomplete | F.endswith(t, F.lit(ending))
    complete = ~incomplete & (follow | t.rlike(question))
    delay = F.when(complete, lx.COMPLETE_DELAY_MS).otherwise(lx.INCOMPLETE_DELAY_MS)
    return F.struct(complete.alias("complete"), follow.alias("follow_up"), delay.alias("delay_ms"))


def is_confirmed(text: Column | str, stock: str = lx.STOCK_FOLLOW_UPS, minimum: int = lx.MIN_COMMIT_CHARS) -> Column:
    """At least four characters once question and exclamation marks are gone, or a stock follow-up."""
    t = F.regexp_replace(tx.trim(tx.text_or_empty(text)), r"[？?。！!]", "")
    return (F.length(t) >= minimum) | t.rlike(stock)


def collapse_repeats(text: Column | str, phrases: Sequence[str] = lx.REPEATED_PHRASES) -> Column:
    """Collapse adjacent repeated phrases and drop single Latin letters standing alone between Han characters."""
    t = F.regexp_replace(tx.trim(tx.text_or_empty(text)), rf"{tx.WS}{{2,}}", " ")
    for phrase in phrases:
        t = F.regexp_replace(t, rf"({phrase})(?:\s*\1)+", "$1")
    around = rf"[{tx.HAN}，。！？?、\s]"
    t = F.regexp_replace(t, rf"(?iu)(?<={around})[a-z](?={around})", "")
    t = F.regexp_replace(t, r"请介绍一下(?:\s*介绍一下)+", "请介绍一下")
    return tx.trim(F.regexp_replace(t, rf"{tx.WS}{{2,}}", " "))


def latest_question(
    text: Column | str,
    starters: Sequence[str] = lx.QUESTION_STARTERS,
    cue: str = lx.TURN_CUE,
    condition: str = lx.CONDITION_SENTENCE,
    condition_tail: str = lx.CONDITION_TAIL,
    generic_tail: str = lx.GENERIC_TAIL,
    whole: str = lx.WHOLE_INTRODUCTION,
    sentence_end: str = "[。！？?]+",
) -> Column:
    """The question a transcript ends with.

    The last sentence, joined with a conditional sentence right before it, else cut at the last starter phrase that
    still leaves a question cue behind it.
    """
    t = F.regexp_replace(tx.trim(tx.text_or_empty(text)), r"^[\s，,。！？?!]+|[\s，,。！？?!]+\z", "")
    sentences = F.filter(F.transform(F.split(t, sentence_end), tx.trim), lambda s: s != "")

    def decide(parts: Column) -> Column:
        last = F.coalesce(F.try_element_at(parts, F.lit(-1)), t)
        previous = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
        joined = (previous != "") & (
            (previous.rlike(condition) & last.rlike(condition_tail)) | last.rlike(generic_tail)
        )
        any_starter = "|".join(tx.quote(s) for s in starters)
        # Cut before every starter; a tail is what remains from one of the later cuts on.
        pieces = F.split(last, f"(?={any_starter})")

        def best(cuts: Column) -> Column:
            tails = F.transform(cuts, lambda _, i: tx.trim(F.array_join(F.filter(cuts, lambda _, j: j >= i), "")))
            return F.try_element_at(F.filter(tails, lambda s, i: (i > 0) & s.rlike(cue)), F.lit(-1))

        cut = tx.let(pieces, best)
        return (
            F.when(joined, F.concat(previous, F.lit("。"), last))
            .when(last.rlike(whole), last)
            .otherwise(F.coalesce(cut, last))
        )

    return tx.let(sentences, decide)


def follow_up_context(
    turns: DataFrame,
    session: str = "session_id",
    order: str = "turn",
    question: str = "question",
    source: str = "source_context",
    n: int = lx.FOLLOW_UP_TURNS,
    out: str = "context",
) -> DataFrame:
    """Add the numbered text of the ``n`` earlier questions of the session with the source text each one hit."""
    payload = F.struct(F.col(question).alias("q"), tx.trim(tx.text_or_empty(source)).alias("s"))
    framed = ordered.previous_rows(turns, [session], order, payload, n, "_prev")
    lines = F.transform(
        "_prev",
        lambda p, i: F.concat(
            F.lit("第 "),
            (i + 1).cast("string"),
            F.lit(" 个前序问题："),
            p["q"],
            F.when(p["s"] != "", F.concat(F.lit("\n命中的原文：\n"), p["s"])).otherwise(""),
        ),
    )
    return framed.withColumn(out, F.array_join(lines, "\n\n")).drop("_prev")


def nfkc(rows: DataFrame, text: str) -> DataFrame:
    """Unicode compatibility form of a text column. Spark has no expression for it, so this is one Arrow pass."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{text: [None if v is None else unicodedata.normalize("NFKC", v) for v in frame[text]]})

    return rows.mapInPandas(run, rows.schema)


def canonical(text: Column | str, punctuation: str = lx.COMPARISON_PUNCTUATION) -> Column:
    """Comparison form of NFKC text: lower case without blanks and punctuation."""
    return F.regexp_replace(F.regexp_replace(F.lower(tx.col(text)), rf"{tx.WS}+", ""), punctuation, "")


def clean_marks(text: Column | str) -> Column:
    """Blanks squeezed, full-width punctuation when the text has Han characters, repeated marks collapsed."""

    def wide(t: Column) -> Column:
        full = F.translate(t, ",?!", "，？！")
        return F.when(t.rlike(r"[\u3400-\u9FFF]"), full).otherwise(t)

    t = tx.let(tx.squeeze(text), wide)
    return F.regexp_replace(F.regexp_replace(t, r"[？?]{2,}", "？"), r"[！!]{2,}", "！")


def clean_display(rows: DataFrame, text: str) -> DataFrame:
    """Display form of transcripts: NFKC, mark clean-up, and a sentence said twice reduced to one."""
    from gleaner.streaming.merge import collapse_doubled

    cleaned = nfkc(rows, text).withColumn(text, clean_marks(text))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{text: [None if v is None else collapse_doubled(v) for v in frame[text]]})

    return cleaned.mapInPandas(run, cleaned.schema)
