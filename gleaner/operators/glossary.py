"""Glossary parsing, merging and dictionary normalisation of a text column."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.functions import text as tx

Entries = Iterable[tuple[str, Sequence[str]]]

_PLAIN_ALIAS = r"(?i)^[a-z0-9 ]+\z"
# Private-use marker around the position of the replaced alias in the dictionary.
_MARK_OPEN, _MARK_CLOSE = "\ue000", "\ue001"
_MARK_DIGITS = "".join(chr(0xE010 + d) for d in range(10))


def parse_glossary(documents: DataFrame, alias_line: str = lx.GLOSSARY_ALIAS_LINE) -> DataFrame:
    """Glossary Markdown to ``(name, ord, term, aliases)``: ``## term`` headings with an alias line below.

    The last alias line under a heading wins, terms without aliases are dropped, and lines above the first heading are
    ignored. Row-local, as the headings of one document never need another row.
    """
    text = F.concat(F.lit("\n"), F.regexp_replace(tx.text_or_empty("markdown"), r"\r\n", "\n"))
    blocks = F.slice(F.split(text, rf"\n(?=##{tx.INLINE_WS}[^\n])"), 2, 2**30)

    def entry(block: Column) -> Column:
        lines = F.split(block, "\n")
        heading = tx.trim(F.regexp_extract(F.element_at(lines, 1), rf"^##{tx.WS}+(.+?){tx.WS}*#*\z", 1))
        found = F.filter(F.slice(lines, 2, 2**30), lambda line: line.rlike(alias_line))
        last = F.regexp_extract(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("")), alias_line, 1)
        aliases = F.filter(F.transform(F.split(last, "[,，、]"), tx.trim), lambda a: a != "")
        return F.struct(heading.alias("term"), aliases.alias("aliases"))

    entries = documents.select("name", F.posexplode(F.transform(blocks, entry)).alias("ord", "e"))
    return entries.select("name", "ord", "e.term", "e.aliases").filter((F.col("term") != "") & (F.size("aliases") > 0))


def merge_glossaries(uploaded: DataFrame, built_in: DataFrame) -> DataFrame:
    """Uploaded entries first, then the built-in entries whose term is missing; columns ``(term, aliases, tier, ord)``."""
    usable = uploaded.filter((tx.text_or_empty("term") != "") & F.col("aliases").isNotNull())
    extra = built_in.join(usable.select("term").distinct(), "term", "left_anti")
    columns = ("term", "aliases")
    return usable.select(*columns, F.lit(0).alias("tier"), "ord").unionByName(
        extra.select(*columns, F.lit(1).alias("tier"), "ord")
    )


def alias_order(entries: Entries) -> list[tuple[str, str]]:
    """``(alias, term)`` pairs, longest alias first, ties in dictionary order."""
    pairs = [(alias, term.strip()) for term, aliases in entries if term for alias in aliases if alias]
    return sorted(pairs, key=lambda p: -len(p[0]))


def _alias_pattern(alias: Column) -> Column:
    quoted = F.regexp_replace(alias, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    edged = F.concat(F.lit("(?iu)(?<![a-z0-9])"), quoted, F.lit("(?![a-z0-9])"))
    return F.when(alias.rlike(_PLAIN_ALIAS), edged).otherwise(F.concat(F.lit("(?iu)"), quoted))


def replace_ordered(text: Column, pairs: Column) -> Column:
    """Apply ``array<struct<alias,term>>`` in order. A replaced span becomes a marker, so no later alias touches it.

    Only aliases that occur in the text are tried, and each is tried as one JVM regular expression.
    """
    numbered = F.transform(
        pairs, lambda p, i: F.struct(p["alias"].alias("alias"), p["term"].alias("term"), i.alias("i"))
    )
    present = tx.let(
        F.lower(text), lambda low: F.filter(numbered, lambda p: F.contains(low, F.lower(p["alias"])))
    )

    def marker(i: Column) -> Column:
        # Position digits become private-use characters, so an alias made of digits cannot match inside a marker.
        digits = F.translate(i.cast("string"), "0123456789", _MARK_DIGITS)
        return F.concat(F.lit(_MARK_OPEN), digits, F.lit(_MARK_CLOSE))

    def apply(found: Column) -> Column:
        marked = F.aggregate(
            found, text, lambda acc, p: F.regexp_replace(acc, _alias_pattern(p["alias"]), marker(p["i"]))
        )
        return F.aggregate(found, marked, lambda acc, p: F.replace(acc, marker(p["i"]), p["term"]))

    return tx.let(present, apply)


def dictionary_column(entries: Entries) -> Column:
    """A dictionary given as Python data, as one array literal in application order."""
    pairs = alias_order(entries)
    if not pairs:
        return F.array().cast("array<struct<alias:string,term:string>>")
    return F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(t).alias("term")) for a, t in pairs])


def normalise_terms(text: Column | str, entries: Entries) -> Column:
    """Dictionary normalisation of a text column with a dictionary given as data; ``normalise_with_table`` takes one that
    is a table."""
    return replace_ordered(tx.col(text), dictionary_column(entries))


def normalise_with_table(texts: DataFrame, dictionary: DataFrame, text: str, key: str) -> DataFrame:
    """The same with a dictionary table ``(term, aliases, tier, ord)`` of any size.

    The aliases present in each text are found by a gram join, gathered per text, and applied in order.
    """
    from gleaner.operators.containment import contains_join

    aliases = (
        dictionary.select("term", "tier", "ord", F.posexplode("aliases").alias("alias_ord", "alias"))
        .filter(tx.text_or_empty("alias") != "")
        .withColumn("needle", F.lower("alias"))
    )
    hay = texts.select(F.lower(text).alias("haystack")).distinct()
    found = contains_join(hay, aliases)
    order = F.struct((-F.length("alias")).alias("neg_len"), "tier", "ord", "alias_ord", "alias", F.trim("term").alias("term"))
    packed = found.groupBy("haystack").agg(F.array_sort(F.collect_list(order)).alias("_pairs"))
    joined = texts.withColumn("_low", F.lower(text)).join(packed, F.col("_low") == F.col("haystack"), "left")
    pairs = F.coalesce(F.col("_pairs"), F.array().cast(packed.schema["_pairs"].dataType))
    return joined.withColumn(text, replace_ordered(F.col(text), pairs)).select(*texts.columns)


def apply_context_rules(text: Column | str, rules: Sequence[tuple] = lx.CONTEXT_RULES) -> Column:
    """Ordered ``(pattern, replacement, require, veto)`` rules, each seeing the output of the one before."""
    out = tx.col(text)
    for pattern, replacement, require, veto in rules:
        out = tx.gated_rewrite(out, pattern, replacement, require, veto)
    return out


def collapse_noise(text: Column | str) -> Column:
    return tx.trim(F.regexp_replace(tx.trim(text), rf"{tx.WS}{{2,}}", " "))


def normalise_question(
    text: Column | str,
    glossary: Entries = lx.EXAMPLE_GLOSSARY,
    corrections: Entries = lx.EXAMPLE_CORRECTIONS,
    rules: Sequence[tuple] = lx.CONTEXT_RULES,
) -> Column:
    """Context rules, blank clean-up, then corrections and glossary as one longest-first dictionary."""
    return normalise_terms(collapse_noise(apply_context_rules(text, rules)), [*corrections, *glossary])


def hot_words(terms: DataFrame, term: str = "term", order: str = "ord", limit: int | None = None) -> DataFrame:
    """Distinct trimmed non-empty terms with the place where each was seen first; with ``limit``, only the first so many."""
    distinct = (
        terms.select(tx.trim(tx.text_or_empty(term)).alias("term"), F.col(order).alias("ord"))
        .filter("term <> ''")
        .groupBy("term")
        .agg(F.min("ord").alias("ord"))
    )
    return distinct if limit is None else distinct.orderBy("ord", "term").limit(limit)
