"""URL filter: host and path rules first, then a character language-model ratio. DataFrame operations only.

Two variable-order Markov models, of the urls that rules accept and of those that rules reject, give each character of a
url a probability after its longest known context, interpolated down to a uniform one (Witten-Bell: a context's share for
shorter contexts grows with the number of different characters that followed it). A url's score is the mean difference of
the models' logarithms per character. The threshold is calibrated on a fifth of the ruled urls that the models do not
see: it lies midway between the means of both sides.

Urls are counted once per distinct text, grams are pre-aggregated before each shuffle, and every table is joined on its
gram, so nothing is broadcast or collected but one row with the calibration sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import lower_ascii
from gleaner.session import materialise

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Longest context in characters, plus the character itself.
GRAM = 5
#: Size of the uniform alphabet below all contexts.
ALPHABET = 256
#: One ruled url in so many calibrates and does not train.
FOLDS = 5
#: Log ratios are added up as whole multiples of this part of one, so that sums do not depend on their order.
UNIT = 1_000_000
#: Stand before and after each url; as contexts they tell its start.
_START, _END = "\u0001", "\u0002"


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = lower_ascii(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit("")))
    return host, F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (null: none) and its verdict."""
    rule = verdict = None
    for r_host, r_path, r_verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == r_host) | F.endswith(host, F.lit("." + r_host))) & F.startswith(path, F.lit(r_path))
        rule = F.when(fits, r_host + r_path) if rule is None else rule.when(fits, r_host + r_path)
        verdict = F.when(fits, r_verdict) if verdict is None else verdict.when(fits, r_verdict)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if rule is None else (rule, verdict)


def with_rules(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``rule_verdict``; a null url has empty host and path."""
    host, path = host_and_path(F.col(url))
    placed = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return placed.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def log_ratios(grams: DataFrame) -> DataFrame:
    """``gram(gram, allow, block)`` with counts → ``(gram, ratio)``: log of the accepted over the rejected probability
    of the last character after the others, as a whole number of 1 / ``UNIT``."""
    below = None
    for n in range(1, GRAM + 1):
        level = grams.groupBy(F.substring("gram", GRAM + 1 - n, n).alias("gram")).agg(
            F.sum("allow").alias("allow"), F.sum("block").alias("block")
        )
        level = level.withColumn("context", F.substring("gram", 1, n - 1))
        contexts = level.groupBy("context").agg(
            F.sum("allow").alias("n_allow"),
            F.sum("block").alias("n_block"),
            F.count_if(F.col("allow") > 0).alias("t_allow"),
            F.count_if(F.col("block") > 0).alias("t_block"),
        )
        level = level.join(contexts, "context")
        if below is None:
            level = level.withColumns({"b_allow": F.lit(1.0 / ALPHABET), "b_block": F.lit(1.0 / ALPHABET)})
        else:
            suffixes = below.select(F.col("gram").alias("suffix"), F.col("p_allow").alias("b_allow"), F.col("p_block").alias("b_block"))
            level = level.withColumn("suffix", F.substring("gram", 2, n - 1)).join(suffixes, "suffix")
        below = level.select("gram", *[_mixed(side).alias(f"p_{side}") for side in ("allow", "block")])
    ratio = F.round((F.ln("p_allow") - F.ln("p_block")) * UNIT).cast("long")
    return below.select("gram", ratio.alias("ratio"))


def _mixed(side: str) -> Column:
    seen, types = F.col(f"n_{side}"), F.col(f"t_{side}")
    return F.when(seen > 0, (F.col(side) + types * F.col(f"b_{side}")) / (seen + types)).otherwise(F.col(f"b_{side}"))


def judge(
    pages: DataFrame,
    url: str = "url",
    fold: str = "page_id",
    rules: Sequence[tuple[str, str, str]] = RULES,
) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (the longest that fits, or null), ``score`` (mean log ratio per character) and
    ``verdict`` (the rule's; without a rule ``allow`` from the calibrated threshold on, else ``block``).

    A null url counts as the empty text; urls of any length are scored whole; equal urls share a score; repeated rows
    are kept; where one side has no ruled url the threshold is 0; an empty table stays empty; columns named like the new
    ones are replaced. ``fold`` is the integer column by which ruled urls are held back for the calibration (null: 0).
    """
    new = ["host", "path", "rule", "score", "verdict"]
    keep = [c for c in pages.columns if c.lower() not in new]
    lowered = lower_ascii(F.coalesce(F.col(url), F.lit("")))
    ruled = with_rules(pages.select(*[f"`{c}`" for c in keep]), url, rules).withColumns(
        {"__u": lowered, "__key": F.xxhash64(lowered), "__check": F.xxhash64(F.concat(F.lit("+"), lowered))}
    )
    held = F.pmod(F.coalesce(F.col(fold), F.lit(0)), F.lit(FOLDS)) == 0
    sides = {}
    for side in ("allow", "block"):
        own = F.col("rule_verdict") == side
        sides[side] = F.count_if(own & ~held).alias(side)
        sides[f"c_{side}"] = F.count_if(own & held).alias(f"c_{side}")
    distinct = ruled.groupBy("__key", "__check", "__u").agg(*sides.values())
    padded = F.concat(F.lit(_START * (GRAM - 1)), F.col("__u"), F.lit(_END))
    # A look-ahead finds overlapping grams in one walk over the text.
    grams = distinct.select("__key", "__check", "allow", "block", "c_allow", "c_block", F.explode(F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))).alias("gram"))
    ratios = log_ratios(grams.groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")))
    of_url = (
        grams.join(ratios, "gram")
        .groupBy("__key", "__check")
        .agg(
            (F.sum("ratio") / F.count("*") / UNIT).alias("score"),
            F.first("c_allow").alias("c_allow"),
            F.first("c_block").alias("c_block"),
        )
    )
    scores = materialise(of_url)
    threshold = _threshold(scores)
    scored = ruled.join(scores.select("__key", "__check", "score"), ["__key", "__check"])
    verdict = F.coalesce(F.col("rule_verdict"), F.when(F.col("score") >= F.lit(threshold), "allow").otherwise("block"))
    return scored.withColumn("verdict", verdict).select(*[f"`{c}`" for c in keep], *new)


def _threshold(scores: DataFrame) -> float:
    """Midway between the mean scores of accepted and rejected urls that were held back; 0 where a side has none."""
    sums = []
    for side in ("allow", "block"):
        n = F.col(f"c_{side}")
        sums += [F.sum(n), F.sum(n * F.col("score"))]
    n_allow, allow, n_block, block = [x or 0 for x in scores.agg(*sums).first()]
    return (allow / n_allow + block / n_block) / 2 if n_allow and n_block else 0.0
