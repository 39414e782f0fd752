"""Section annotation: project, role, aliases, scope class, readable id and retrieval text. Row-local expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.functions import text as tx

_COMPACT = r"[：:？?。！!（）()\[\]]"


def compact(c: Column | str) -> Column:
    return tx.squeeze(F.regexp_replace(tx.text_or_empty(c), _COMPACT, " "))


def compact_distinct(values: Column) -> Column:
    """Compacted values of an array, in order, distinct, at least two characters long."""
    return F.array_distinct(F.filter(F.transform(values, compact), lambda v: F.length(v) >= 2))


def is_profile(
    title: Column | str = "title",
    content: Column | str = "content",
    label: str = lx.PROFILE_LABEL,
    opening: str = lx.PROFILE_OPENING,
) -> Column:
    """The title says so, or the pattern of an opening occurs in the content, which is searched whole."""
    return tx.matches(title, label) | tx.text_or_empty(content).rlike(opening)


def source_stem(source: Column | str = "source", prefix: str = lx.SOURCE_PREFIX) -> Column:
    stem = F.regexp_replace(tx.text_or_empty(source), lx.FILE_SUFFIX, "")
    return tx.trim(F.regexp_replace(stem, prefix, ""))


def inferred_project(
    project: Column | str = "project",
    source: Column | str = "source",
    profile: Column | None = None,
    generic_source: str = lx.GENERIC_SOURCE,
    generic_project: str = lx.GENERIC_PROJECT,
    project_word: str = lx.PROJECT_WORD,
    source_prefix: str = lx.SOURCE_PREFIX,
) -> Column:
    """The project label if it names a project and is not generic, else the cleaned source stem, else empty."""
    label = tx.trim(tx.text_or_empty(project))
    stem = source_stem(source, source_prefix)
    named = (label != "") & ~label.rlike(generic_project) & label.rlike(project_word)
    unusable = (stem == "") | stem.rlike(generic_source) | stem.rlike(generic_project)
    out = F.when(named, label).when(unusable, "").otherwise(stem)
    return out if profile is None else F.when(profile, "").otherwise(out)


def section_role(
    profile: Column,
    project: Column,
    rules: Sequence[tuple[str, str]] = lx.ROLE_RULES,
    title: Column | str = "title",
    content: Column | str = "content",
) -> Column:
    text = F.concat(tx.text_or_empty(title), F.lit("\n"), tx.text_or_empty(content))
    rest = tx.first_rule(text, rules, F.when(project != "", "project").otherwise("general"))
    return F.when(profile, "profile").otherwise(rest)


def card_aliases(title: Column | str = "title", rules: Sequence[tuple[str, Sequence[str]]] = lx.ALIAS_RULES) -> Column:
    """The compacted title followed by the aliases of every rule whose pattern it matches."""
    label = compact(title)
    none = F.array().cast("array<string>")
    groups = [F.when(label.rlike(p), F.array(*map(F.lit, aliases))).otherwise(none) for p, aliases in rules]
    return compact_distinct(F.concat(F.array(label), *groups))


def card_scope(
    role: Column | str = "role",
    inferred: Column | str = "inferred_project",
    project: Column | str = "project",
    general: str = lx.GENERAL_SCOPE_PROJECT,
) -> Column:
    return (
        F.when(tx.col(role) == "profile", "personal")
        .when(tx.col(role) == "general", "general")
        .when(tx.text_or_empty(inferred) != "", "project")
        .when(tx.matches(project, general), "general")
        .otherwise("project")
    )


def _project_or_label(inferred: Column | str, project: Column | str) -> Column:
    inferred = tx.text_or_empty(inferred)
    return F.when(inferred != "", inferred).otherwise(tx.text_or_empty(project))


def card_id(
    source: Column | str = "source",
    inferred: Column | str = "inferred_project",
    project: Column | str = "project",
    title: Column | str = "title",
    chunk_index: Column | str = "chunk_index",
) -> Column:
    parts = F.concat_ws(
        "-",
        F.substring(compact(source), 1, 80),
        F.substring(compact(_project_or_label(inferred, project)), 1, 80),
        F.substring(compact(title), 1, 120),
        F.coalesce(tx.col(chunk_index), F.lit(0)).cast("string"),
    )
    return F.concat(F.lit("card-"), F.lower(F.regexp_replace(parts, r"[^\p{L}\p{N}-]+", "-")))


def retrieval_text(
    inferred: Column | str = "inferred_project",
    project: Column | str = "project",
    title: Column | str = "title",
    aliases: Column | str = "aliases",
    content: Column | str = "content",
) -> Column:
    parts = F.concat(
        F.array(_project_or_label(inferred, project), tx.text_or_empty(title)),
        tx.col(aliases),
        F.array(tx.text_or_empty(content)),
    )
    return F.array_join(compact_distinct(parts), "\n")


def annotate(
    sections: DataFrame,
    role_rules: Sequence[tuple[str, str]] = lx.ROLE_RULES,
    alias_rules: Sequence[tuple[str, Sequence[str]]] = lx.ALIAS_RULES,
    profile_label: str = lx.PROFILE_LABEL,
    profile_opening: str = lx.PROFILE_OPENING,
) -> DataFrame:
    """All annotation columns of a card at once; ``sections`` needs title, content, project, source, chunk_index."""
    profile = is_profile(label=profile_label, opening=profile_opening)
    return (
        sections.withColumn("inferred_project", inferred_project(profile=profile))
        .withColumn("role", section_role(profile, F.col("inferred_project"), role_rules))
        .withColumns({"aliases": card_aliases(rules=alias_rules), "card_scope": card_scope()})
        .withColumns({"card_id": card_id(), "retrieval_text": retrieval_text()})
    )


def answer_excerpt(content: Column | str, marker: str = lx.ANSWER_MARKER) -> Column:
    """The text after the first answer marker, or all of it."""
    body = tx.trim(tx.text_or_empty(content))
    return F.when(body.rlike(marker), tx.trim(F.regexp_replace(body, rf"(?s)\A.*?(?:{marker})(.*)\z", "$1"))).otherwise(body)
