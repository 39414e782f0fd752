"""Project context, question scope and material eligibility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.functions import text as tx
from gleaner.operators import annotate, ordered, turns
from gleaner.operators.containment import contained_words, contains_join

SECTION_KEY = ("doc_ord", "section_ord", "chunk_index")


def project_name(inferred: str = "inferred_project", project: str = "project") -> Column:
    label = tx.text_or_empty(inferred)
    return F.when(label != "", label).otherwise(tx.trim(tx.text_or_empty(project)))


def project_options(sections: DataFrame, key: Sequence[str] = SECTION_KEY, aliases: DataFrame | None = None) -> DataFrame:
    """One row per project, its first spelling in corpus order, and its aliases from an optional ``(id, alias)`` table."""
    named = sections.select(project_name().alias("name"), F.struct(*key).alias("ord")).filter("name <> ''")
    options = named.groupBy(F.lower("name").alias("id")).agg(
        F.min_by("name", "ord").alias("name"), F.min("ord").alias("ord")
    )
    if aliases is None:
        return options.withColumn("aliases", F.array().cast("array<string>"))
    gathered = aliases.groupBy("id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return options.join(gathered, "id", "left").withColumn(
        "aliases", F.coalesce("aliases", F.array().cast("array<string>"))
    )


def sections_for_projects(sections: DataFrame, projects: DataFrame) -> DataFrame:
    """Sections of the given project ids, as an equi join on the id."""
    return sections.withColumn("_id", F.lower(project_name())).join(
        projects.select(F.col("id").alias("_id")).distinct(), "_id", "left_semi"
    ).drop("_id")


def explicit_projects(
    questions: DataFrame, projects: DataFrame, text: str = "query", sizes: tuple[int, ...] = (1, 2, 3)
) -> DataFrame:
    """``(query_id, explicit_id)``: the project whose longest name or alias stands in the question.

    ``sizes`` are the lengths of names that occur, the largest standing for itself and more. A name without a blank that
    is as long as that stands inside a word, so it is sought in the questions' distinct words, whose best project goes
    back to the questions by word. Only the other names are sought in whole texts.
    """
    size = max(sizes)
    names = projects.select(
        "id", "ord", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("pos", "n")
    ).filter(tx.text_or_empty("n") != "")
    names = names.select(
        F.lower("n").alias("needle"), F.struct((-F.length("n")).alias("length"), "ord", "pos", "id").alias("choice")
    )
    asked = questions.select("query_id", F.lower(tx.text_or_empty(text)).alias("haystack"))
    within = (F.length("needle") >= size) & ~F.contains("needle", F.lit(" "))

    words = asked.select("query_id", F.explode(F.array_distinct(F.split("haystack", " "))).alias("word"))
    words = words.filter(F.length("word") >= size)
    found = contained_words(words.select("word").distinct(), names.select("needle").filter(within).distinct(), size=size)
    by_word = found.join(names, "needle").groupBy("word").agg(F.min("choice").alias("choice"))
    best = words.join(by_word, "word").select("query_id", "choice")

    others = names.filter(~within)
    if not others.isEmpty():
        pairs = contains_join(asked.select("haystack").distinct(), others.select("needle").distinct(), sizes=sizes)
        by_text = pairs.join(others, "needle").groupBy("haystack").agg(F.min("choice").alias("choice"))
        best = best.unionByName(asked.join(by_text, "haystack").select("query_id", "choice"))
    return best.groupBy("query_id").agg(F.min("choice").alias("choice")).select(
        "query_id", F.col("choice.id").alias("explicit_id")
    )


def resolve_context(
    text: Column | str,
    explicit: Column | str,
    active: Column | str,
    locked: Column | str | None = None,
    barrier: str = lx.UNKNOWN_PROJECT_BARRIER,
) -> Column:
    """Struct of ``project_id``, ``source`` and ``confidence``: locked, explicit, barrier, carried, unknown."""
    locked = F.lit(None).cast("string") if locked is None else tx.col(locked)
    explicit, active = tx.col(explicit), tx.col(active)

    def result(project: Column, source: str, confidence: float) -> Column:
        return F.struct(
            project.cast("string").alias("project_id"),
            F.lit(source).alias("source"),
            F.lit(confidence).cast("double").alias("confidence"),
        )

    nothing = result(F.lit(""), "unknown", 0.0)
    return (
        F.when(tx.text_or_empty(locked) != "", result(locked, "locked", 1.0))
        .when(tx.text_or_empty(explicit) != "", result(explicit, "explicit", 1.0))
        .when(tx.matches(text, barrier), nothing)
        .when(tx.text_or_empty(active) != "", result(active, "context", 0.7))
        .otherwise(nothing)
    )


def carry_project(
    turns_df: DataFrame, session: str, order: str, explicit: str, experience: Column, out: str = "active_id"
) -> DataFrame:
    """The active project before each turn: changed only by an explicit mention in a non-experience question."""
    change = F.when(~experience & (tx.text_or_empty(explicit) != ""), F.col(explicit))
    return ordered.carry_forward(turns_df, [session], order, change, out)


def no_blanks(text: Column | str) -> Column:
    return F.regexp_replace(tx.text_or_empty(text), rf"{tx.WS}+", "")


def is_experience(text: Column | str, patterns: Sequence[str] = lx.EXPERIENCE_QUESTION) -> Column:
    return tx.any_rule(no_blanks(text), patterns)


def is_external_product(
    text: Column | str,
    product: Sequence[str] = lx.EXTERNAL_PRODUCT,
    named: str = lx.NAMED_AI_PRODUCT,
    named_question: str = lx.NAMED_PRODUCT_QUESTION,
    domain: str = lx.AI_DOMAIN,
) -> Column:
    t = no_blanks(text)
    return (t.rlike(named) & t.rlike(named_question)) | (tx.any_rule(t, product) & ~t.rlike(domain))


def answer_scope(
    experience: Column, product: Column, follow_up: Column, source: Column | str, strict_followup: bool = False
) -> Column:
    """experience → explicit project → product → follow-up → general.

    A follow-up counts as soon as it has any project source, even ``unknown``; ``strict_followup`` asks for a real one.
    """
    source = tx.text_or_empty(source)
    attached = source.isin("locked", "explicit", "context") if strict_followup else source != ""
    return (
        F.when(experience, "experience")
        .when(source == "explicit", "project")
        .when(product, "product")
        .when(follow_up & attached, "followup")
        .otherwise("general")
    )


def should_scope(
    resolved: Column | str,
    text: Column | str,
    experience: Column | None = None,
    follow_up: Column | None = None,
    contextual: str = lx.CONTEXTUAL_SCOPE,
) -> Column:
    """Whether the question is restricted to its project."""
    r = tx.col(resolved)
    experience = is_experience(text) if experience is None else experience
    follow_up = turns.is_follow_up(text) if follow_up is None else follow_up
    carried = (r["source"] == "context") & (follow_up | tx.matches(text, contextual))
    return (r["project_id"] != "") & ~experience & (r["source"].isin("explicit", "locked") | carried)


# ---------------------------------------------------------------------------------------------------------------------
# Eligibility. Everything that depends on the section alone is computed once per section; a question only selects among
# those flags, so the pairs to test are the scored candidates and never questions × sections.
# ---------------------------------------------------------------------------------------------------------------------


def normal_title(title: Column | str, synonyms: Sequence[tuple[str, str]] = lx.SYNONYMS) -> Column:
    """A title reduced to what it asks about, for comparing two titles."""
    t = tx.text_or_empty(title)
    for pattern, replacement in synonyms:
        t = F.regexp_replace(t, pattern, replacement)
    t = F.regexp_replace(t, rf"[^{tx.HAN}A-Za-z0-9]", "")
    return F.lower(F.regexp_replace(t, lx.TITLE_FILLERS, ""))


def without_current_twin(archived: DataFrame, current: DataFrame, key: Sequence[str] = SECTION_KEY) -> DataFrame:
    """Archived rows with no current row of the same source asking the same question (one title containing the other).

    Titles that contain one another are found on distinct titles by grams, whatever their source, so a source with very
    many titles is no product of its rows; the source is compared on the hits.
    """
    a = archived.withColumn("_t", normal_title("title"))
    c = current.select("source", normal_title("title").alias("_c")).filter(F.length("_c") >= 4).distinct()
    titles = a.filter(F.length("_t") >= 4).select("source", "_t").distinct()
    old, new = titles.select("_t").distinct(), c.select("_c").distinct()
    wider = contains_join(old, new, "_t", "_c", sizes=(3,)).select("_t", "_c")
    narrower = contains_join(new, old, "_c", "_t", sizes=(3,)).select("_t", "_c")
    alike = wider.unionByName(narrower).distinct()
    twins = titles.join(alike, "_t").join(c, ["source", "_c"], "left_semi").select("source", "_t").distinct()
    return a.join(twins, ["source", "_t"], "left_anti").drop("_t")


def section_flags(
    sections: DataFrame,
    glossary_source: str = lx.GLOSSARY_SOURCE,
    profile: Column | None = None,
    methodology_source: str = lx.METHODOLOGY_SOURCE,
    practice: str = lx.PERSONAL_PRACTICE_EVIDENCE,
    trend: str = lx.TREND_EVIDENCE,
    technology: str = lx.TECHNOLOGY_TITLE,
    key: Sequence[str] = SECTION_KEY,
) -> DataFrame:
    """Sections that may answer at all, with the flags eligibility reads.

    ``superseded_all`` and ``superseded_np``: an archived row whose source has a current row, among all rows and among
    the rows that are not personal profiles.
    """
    profile = annotate.is_profile() if profile is None else profile
    glossary = F.coalesce(F.col("source_type") == "glossary", F.lit(False)) | tx.matches("source", glossary_source)
    skill = F.coalesce(F.col("source_type") == "skill", F.lit(False))
    text = F.concat(tx.text_or_empty("title"), F.lit("\n"), tx.text_or_empty("content"))
    archive = F.coalesce(F.col("archive"), F.lit(False))
    rows = sections.filter(~glossary & ~skill).withColumns({"is_profile": profile, "archive": archive})
    current = rows.filter(~F.col("archive") & (tx.text_or_empty("source") != ""))
    sources = current.groupBy("source").agg(F.max((~F.col("is_profile")).cast("int")).alias("_current_np"))
    flagged = rows.join(sources, "source", "left").withColumns(
        {
            "superseded_all": F.col("archive") & F.col("_current_np").isNotNull(),
            "superseded_np": F.col("archive") & (F.coalesce("_current_np", F.lit(0)) == 1),
            "is_practice": F.col("is_profile") | text.rlike(practice),
            "is_trend": text.rlike(trend),
            "is_methodology": tx.matches("source", methodology_source) & ~F.col("archive"),
            "is_technology": tx.matches("title", technology),
        }
    )
    return flagged.drop("_current_np")


def scope_class(scope: Column | str) -> Column:
    """Which rows a scope may see: ``none``, everything but profiles (``np``), or ``all``."""
    s = tx.col(scope)
    return F.when(s == "product", "none").when(s.isin("general", "project", "followup"), "np").otherwise("all")


def is_eligible(scope: Column | str = "scope") -> Column:
    """Scope and version rule for a (question, flagged section) row."""
    c = scope_class(scope)
    return ((c == "all") & ~F.col("superseded_all")) | ((c == "np") & ~F.col("is_profile") & ~F.col("superseded_np"))


def explicit_archive_answer(
    query: Column | str, title: Column | str, archive: Column | str = "archive", question_title: str = lx.QUESTION_TITLE
) -> Column:
    """An archived row whose title is what the question asks."""
    words = F.regexp_extract_all(tx.text_or_empty(query), F.lit(r"(?iu)[a-z][a-z0-9_-]{1,}"), 0)
    hit = F.exists(words, lambda w: F.rlike(tx.text_or_empty(title), _whole_word(w)))
    return tx.col(archive) & (phrase_in_title(query, title) | (hit & tx.matches(title, question_title)))


def _whole_word(term: Column) -> Column:
    return F.concat(F.lit(f"(?iu){tx.EDGE}"), term, F.lit(tx.EDGE))


def han_phrase(query: Column | str) -> Column:
    """The question's Han characters, fillers removed."""
    q = tx.text_or_empty(query)
    for pattern, replacement in lx.SYNONYMS:
        q = F.regexp_replace(q, pattern, replacement)
    return F.regexp_replace(han_part(q), lx.PHRASE_FILLERS, "")


def han_part(text: Column | str) -> Column:
    return F.regexp_replace(tx.text_or_empty(text), rf"[^{tx.HAN}]", "")


def phrase_in_title(query: Column | str, title: Column | str) -> Column:
    """A Han phrase of four or more characters, fillers removed, inside the Han part of the title."""
    phrase = han_phrase(query)
    return (F.length(phrase) >= 4) & F.contains(han_part(title), phrase)


def select_materials(
    pairs: DataFrame,
    flags: DataFrame,
    key: Sequence[str] = SECTION_KEY,
    query: str = "query",
    practice_question: Column | None = None,
    trend_question: Column | None = None,
    direct_question: Column | None = None,
    dedupe: bool = False,
    question_title: str = lx.QUESTION_TITLE,
) -> DataFrame:
    """Keep the (question, section) pairs whose section the question may use.

    ``pairs`` carries ``query_id``, the query text, ``scope`` and the columns of ``flags``. Archived direct answers are
    re-admitted for project and follow-up questions (twice, unless ``dedupe``), and the personal-practice, trend and
    methodology preferences fall back to the plain eligible rows where they would leave nothing. Whether a preference
    has any row is decided over the whole of ``flags``, by three flags in a single row.
    """
    practice_question = (
        tx.matches(no_blanks(query), lx.PERSONAL_PRACTICE_FIRST_PERSON)
        & tx.matches(no_blanks(query), lx.PERSONAL_PRACTICE_SUBJECT)
        if practice_question is None
        else practice_question
    )
    trend_question = tx.matches(query, lx.TREND_QUESTION) if trend_question is None else trend_question
    direct_question = tx.matches(query, lx.DIRECT_ANSWER_QUESTION) if direct_question is None else direct_question
    usable_all, usable_np = ~F.col("superseded_all"), ~F.col("is_profile") & ~F.col("superseded_np")

    def some(condition: Column) -> Column:
        return F.coalesce(F.max(condition.cast("int")), F.lit(0)) == 1

    exists = flags.agg(
        some(usable_all & F.col("is_practice")).alias("_any_practice"),
        some(usable_np & F.col("is_trend")).alias("_any_trend"),
        some(usable_np & F.col("is_methodology")).alias("_any_methodology"),
    )
    not_profile = flags.filter(~F.col("is_profile"))
    lone = without_current_twin(not_profile.filter("archive"), not_profile.filter(~F.col("archive")), key)
    lone = lone.select(*key).withColumn("_lone", F.lit(True))

    scope = F.col("scope")
    rows = pairs.join(lone, list(key), "left").join(F.broadcast(exists))
    archive_answer = explicit_archive_answer(query, "title", question_title=question_title)
    rows = rows.withColumns(
        {
            "_eligible": is_eligible(),
            "_explicit": (scope == "general")
            & ~F.col("is_profile")
            & archive_answer
            & F.coalesce(F.col("_lone"), F.lit(False)),
            "_again": scope.isin("project", "followup")
            & direct_question
            & ~F.col("is_profile")
            & F.col("archive")
            & (archive_answer | F.col("is_technology")),
            "_practice": (scope == "experience") & practice_question & F.col("_any_practice"),
            "_trend": (scope == "general") & trend_question & F.col("_any_trend"),
        }
    )
    explicit = rows.filter("_explicit").select("query_id").distinct().withColumn("_has_explicit", F.lit(True))
    rows = rows.join(explicit, "query_id", "left")
    has_explicit = F.coalesce(F.col("_has_explicit"), F.lit(False))
    general = (
        F.when(F.col("_any_methodology"), (F.col("_eligible") & F.col("is_methodology")) | F.col("_explicit"))
        .when(has_explicit, F.col("_explicit"))
        .otherwise(F.col("_eligible"))
    )
    once = (
        F.when(F.col("_practice"), F.col("_eligible") & F.col("is_practice"))
        .when(F.col("_trend"), F.col("_eligible") & F.col("is_trend"))
        .when(scope == "general", general)
        .otherwise(F.col("_eligible"))
    )
    copies = once.cast("int") + F.col("_again").cast("int")
    copies = F.least(copies, F.lit(1)) if dedupe else copies
    kept = rows.withColumn("_copies", copies).filter("_copies > 0")
    helper = [c for c in kept.columns if c.startswith("_")]
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).drop(*helper, "_copy")


def personal_context(
    sections: DataFrame,
    key: Sequence[str] = SECTION_KEY,
    profile: Column | None = None,
) -> DataFrame:
    """One row: the first profile section, titled, whole. Empty when the corpus has none."""
    profile = annotate.is_profile() if profile is None else profile
    body = F.concat(F.lit("【"), tx.text_or_empty("title"), F.lit("】\n"), tx.text_or_empty("content"))
    first = sections.filter(profile).agg(F.min_by(body, F.struct(*key)).alias("body"))
    return first.select(F.coalesce("body", F.lit("")).alias("personal_context"))


def add_personal_context(questions: DataFrame, context: DataFrame) -> DataFrame:
    """Attach the one-row context to the questions whose scope may use it."""
    usable = F.col("scope").isin(*lx.PERSONAL_CONTEXT_SCOPES)
    joined = questions.join(F.broadcast(context.limit(1)))
    return joined.withColumn("personal_context", F.when(usable, F.col("personal_context")).otherwise(""))
