"""Routing a question to an answer mode, picking evidence and assembling context.

All inputs are already a few rows per question (ranked candidates and the overview, technology and profile picks), so
the joins and groupings here are on ``query_id`` over tables the size of the question table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.functions import text as tx
from gleaner.operators import annotate
from gleaner.operators.containment import contains_join
from gleaner.operators.fusion import IDENTITY
from gleaner.operators.policy import han_part, han_phrase, no_blanks, phrase_in_title
from gleaner.session import bounded_broadcast, materialise

SECTION_KEY = ("doc_ord", "section_ord", "chunk_index")
MATCH_FIELDS = (*SECTION_KEY, "source", "project", "title", "content", "score", "match_type", "semantic_score")
_TECH = r"[a-z][a-z0-9_-]{1,}"


def question_predicates(
    text: Column | str,
    profile: Sequence[str] = lx.PROFILE_QUESTION,
    own_overview: Sequence[str] = lx.OWN_PROJECT_OVERVIEW,
    practice: tuple[str, str] = (lx.PERSONAL_PRACTICE_FIRST_PERSON, lx.PERSONAL_PRACTICE_SUBJECT),
    zero_to_one: Sequence[str] = lx.ZERO_TO_ONE_QUESTION,
    scenario: Sequence[str] = lx.SCENARIO_QUESTION,
    technology: str = lx.TECHNOLOGY_QUESTION,
    count: str = lx.COUNT_QUESTION,
    overview: Sequence[str] = lx.OVERVIEW_QUESTION,
    overview_veto: str = lx.TECHNICAL_TOPIC,
    overview_always: str = lx.OVERVIEW_ALWAYS,
) -> dict[str, Column]:
    """The boolean columns routing branches on."""
    t, dense = tx.text_or_empty(text), no_blanks(text)
    return {
        "q_own_overview": tx.any_rule(dense, own_overview),
        "q_profile": tx.any_rule(dense, profile),
        "q_practice": dense.rlike(practice[0]) & dense.rlike(practice[1]),
        "q_zero_to_one": tx.any_rule(dense, zero_to_one),
        "q_scenario": tx.any_rule(dense, scenario),
        "q_technology": t.rlike(technology),
        "q_count": t.rlike(count),
        "q_overview": (~t.rlike(overview_veto) & tx.any_rule(t, overview)) | t.rlike(overview_always),
    }


def is_metadata(
    title: Column | str = "title",
    content: Column | str = "content",
    title_rule: str = lx.METADATA_TITLE,
    text_rule: str = lx.METADATA_TEXT,
) -> Column:
    """Container headings and provenance notes, which never answer a question."""
    label = tx.trim(tx.text_or_empty(title))
    text = F.concat(label, F.lit("\n"), tx.text_or_empty(content))
    return label.rlike(title_rule) | text.rlike(text_rule)


def priority_pick(
    materials: DataFrame,
    rules: Sequence[tuple[int, str]],
    take: int,
    floor: int,
    key: Sequence[str] = SECTION_KEY,
    metadata: Column | None = None,
) -> DataFrame:
    """The best titled sections per question: by priority, then corpus order, one per title, at most ``take``.

    Sections without a priority are dropped before any shuffle, so only the few matching titles are ranked.
    """
    metadata = is_metadata() if metadata is None else metadata
    title = tx.trim(tx.text_or_empty("title"))
    priority = None
    for level, pattern in rules:
        hit = tx.matches("title", pattern)
        priority = F.when(hit, level) if priority is None else priority.when(hit, level)
    ranked = materials.filter(~metadata).withColumns({"priority": priority, "_label": title})
    ranked = ranked.filter(F.col("priority").isNotNull())
    order = [F.col("priority").desc(), *key]
    per_title = Window.partitionBy("query_id", "_label").orderBy(*order)
    per_question = Window.partitionBy("query_id").orderBy(*order)
    return (
        ranked.withColumn("_t", F.row_number().over(per_title))
        .filter("_t = 1")
        .withColumn("rank", F.row_number().over(per_question))
        .filter(F.col("rank") <= take)
        .withColumns(
            {"score": F.greatest(F.coalesce("score", F.lit(0)), F.lit(floor)), "match_type": F.lit("keyword")}
        )
        .drop("_t", "_label")
    )


def explicit_title(query: Column | str, title: Column | str, question_title: str = lx.QUESTION_TITLE) -> Column:
    """The title states the question: its Han phrase, or every technical term of the question as a whole word."""
    terms = F.array_distinct(F.regexp_extract_all(tx.text_or_empty(query), F.lit(f"(?iu){_TECH}"), 0))
    label = tx.text_or_empty(title)
    every = F.forall(terms, lambda t: F.rlike(label, F.concat(F.lit(f"(?iu){tx.EDGE}"), t, F.lit(tx.EDGE))))
    technical = (F.size(terms) >= 1) & every & label.rlike(question_title)
    return phrase_in_title(query, title) | technical


def stated_questions(questions: DataFrame, titles: DataFrame, question_title: str = lx.QUESTION_TITLE) -> DataFrame:
    """``query_id`` of the questions that some title states; the others have no explicit title, wherever sections rank.

    A title that states a question holds its Han phrase or its longest technical term, so the two meet by these.
    """

    def alike(text: Column) -> Column:
        # What a pattern that ignores case takes for s, k and i.
        return F.lower(F.translate(text, "\u017f\u212a\u0130\u0131", "skii"))

    terms = F.regexp_extract_all(tx.text_or_empty("query"), F.lit(f"(?iu){_TECH}"), 0)
    longest = F.array_max(F.transform(terms, lambda t: F.struct(F.length(t).alias("n"), t.alias("term"))))["term"]
    phrase = F.when(F.length(han_phrase("query")) >= 4, han_phrase("query"))
    sought = F.array_compact(F.array(alike(longest), phrase))
    needles = materialise(questions.select("query_id", "query", F.explode(sought).alias("needle")))
    held = F.array_distinct(F.array(alike(F.col("title")), han_part("title")))
    haystacks = titles.filter("title <> ''").select("title").distinct().withColumn("haystack", F.explode(held))
    met = contains_join(haystacks, needles.select("needle").distinct(), sizes=(2, 3)).join(bounded_broadcast(needles), "needle")
    return met.filter(explicit_title("query", "title", question_title)).select("query_id").distinct()


def difference_subjects(
    query: Column | str,
    pattern: str = lx.DIFFERENCE_SUBJECT,
    splitter: str = lx.DIFFERENCE_SPLIT,
    prefix: str = lx.DIFFERENCE_PREFIX,
    generic: str = lx.DIFFERENCE_GENERIC,
) -> Column:
    """The things a comparison question compares."""
    t = tx.trim(F.regexp_replace(tx.text_or_empty(query), r"[？?。！!]", ""))
    subjects = F.transform(
        F.split(F.regexp_extract(t, pattern, 1), splitter), lambda s: tx.trim(F.regexp_replace(s, prefix, ""))
    )
    return F.filter(subjects, lambda s: (F.length(s) >= 2) & ~s.rlike(generic))


def specific_evidence(
    query: Column | str,
    text: Column,
    subjects: Column | None = None,
    keyword_fillers: str = lx.KEYWORD_FILLERS,
    keyword_terms: str = lx.KEYWORD_TERMS,
    redo: tuple[str, str] = (lx.REDO_QUESTION, lx.REDO_EVIDENCE),
    done: tuple[str, str] = (lx.DONE_QUESTION, lx.DONE_EVIDENCE),
) -> Column:
    """Whether a section's text can carry an answer to the question.

    Compared subjects must occur (any), technical terms must all occur, a redo question needs redo evidence; then one
    keyword, or two distinct meaningful Han characters, must be shared.
    """
    q = tx.text_or_empty(query)
    low_q = F.lower(q)
    subjects = difference_subjects(query) if subjects is None else subjects

    def judge(low: Column) -> Column:
        compared = (F.size(subjects) == 0) | F.exists(subjects, lambda s: F.contains(low, F.lower(s)))
        terms = F.regexp_extract_all(low_q, F.lit(_TECH), 0)
        technical = F.forall(terms, lambda t: F.contains(low, t))
        redone = ~q.rlike(redo[0]) | low.rlike(redo[1])
        words = F.regexp_extract_all(F.regexp_replace(low_q, keyword_fillers, " "), F.lit(keyword_terms), 0)
        keyword = F.exists(words, lambda w: F.contains(low, w))
        did = q.rlike(done[0]) & low.rlike(done[1])
        characters = F.array_distinct(F.regexp_extract_all(q, F.lit(rf"[{tx.HAN}]"), 0))
        ignored = list(dict.fromkeys(lx.IGNORED_CHARACTERS))
        shared = F.filter(characters, lambda c: ~c.isin(*ignored) & F.contains(low, c))
        return compared & technical & redone & (keyword | did | (F.size(shared) >= 2))

    return tx.let(F.lower(text), judge)


def section_text(title: str = "title", project: str = "project", content: str = "content") -> Column:
    return F.concat_ws(" ", *[tx.text_or_empty(c) for c in (title, project, content)])


def count_evidence(title: str = "title", content: str = "content", pattern: str = lx.COUNT_EVIDENCE) -> Column:
    return F.concat_ws(" ", tx.text_or_empty(title), tx.text_or_empty(content)).rlike(pattern)


def available_candidates(candidates: DataFrame, eligible: DataFrame, take: int = lx.ROUTED_RESULTS) -> DataFrame:
    """Ranked candidates that are still eligible for their question, the first ``take`` of them, ranked again."""
    present = candidates.join(eligible.select("query_id", *IDENTITY).distinct(), ["query_id", *IDENTITY], "left_semi")
    window = Window.partitionBy("query_id").orderBy("rank")
    return present.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= take)


def _matches(rows: DataFrame, out: str, extra: Sequence[str] = ()) -> DataFrame:
    """A question's few ranked rows as one ordered array."""
    fields = F.struct("rank", *MATCH_FIELDS, *extra)
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(fields)).alias(out))


def _with_match_fields(rows: DataFrame) -> DataFrame:
    present = set(rows.columns)
    for field, kind in (("semantic_score", "double"), ("project", "string"), ("section_ord", "int")):
        if field not in present:
            rows = rows.withColumn(field, F.lit(None).cast(kind))
    return rows.withColumns({"score": F.col("score").cast("double"), "rank": F.col("rank").cast("int")})


def _field_is_true(name: str):
    return lambda m: m[name]


def route(
    questions: DataFrame,
    candidates: DataFrame,
    overview: DataFrame | None = None,
    technology: DataFrame | None = None,
    profile_first: DataFrame | None = None,
    query: str = "query",
    predicates: dict[str, Column] | None = None,
    metadata: Column | None = None,
    profile: Column | None = None,
    practice: Column | None = None,
    explicit: Column | None = None,
    specific: Column | None = None,
    counted: Column | None = None,
) -> DataFrame:
    """The decision per question: ``query_id, mode, confidence, reason, matches``.

    ``questions`` has the query text and ``allow_overview``; ``candidates`` are the available ranked rows of each
    question (before the cut to four, see below); ``overview`` and ``technology`` come from ``priority_pick`` and
    ``profile_first`` holds the first profile section a question may use. Candidates are cut to four separately among
    answer sections and among profile sections.
    """
    predicates = question_predicates(query) if predicates is None else predicates
    metadata = is_metadata() if metadata is None else metadata
    profile = annotate.is_profile() if profile is None else profile
    practice = (
        F.concat_ws("\n", tx.text_or_empty("title"), tx.text_or_empty("content")).rlike(lx.PERSONAL_PRACTICE_MATERIAL)
        if practice is None
        else practice
    )
    explicit = explicit_title("_query", "title") if explicit is None else explicit
    specific = specific_evidence("_query", section_text()) if specific is None else specific
    counted = count_evidence() if counted is None else counted

    rows = _with_match_fields(candidates).join(questions.select("query_id", F.col(query).alias("_query")), "query_id")
    rows = rows.withColumns({"_meta": metadata, "_profile": profile})
    again = Window.partitionBy("query_id").orderBy("rank")

    def top(selected: DataFrame, take: int) -> DataFrame:
        return selected.withColumn("rank", F.row_number().over(again)).filter(F.col("rank") <= take)

    answers = top(rows.filter(~F.col("_meta")), lx.ROUTED_RESULTS).withColumns(
        {"f_practice": practice, "f_explicit": explicit, "f_specific": specific, "f_count": counted}
    )
    ranked = _matches(answers, "m", ("f_practice", "f_explicit", "f_specific", "f_count"))
    profiles = _matches(top(rows.filter("_profile"), 1), "p")
    d = questions.withColumns(predicates).join(ranked, "query_id", "left").join(profiles, "query_id", "left")
    plain = profiles.schema["p"].dataType.simpleString()
    for name, pick in (("o", overview), ("t", technology), ("pf", profile_first)):
        if pick is None:
            d = d.withColumn(name, F.array().cast(plain))
        else:
            d = d.join(_matches(_with_match_fields(pick), name), "query_id", "left")

    empty = F.array().cast(plain)
    flags = ("f_practice", "f_explicit", "f_specific", "f_count")

    def bare(array: Column) -> Column:
        """The match struct without the routing flags."""
        fields = ["rank", *MATCH_FIELDS]
        return F.transform(F.coalesce(array, F.array()), lambda m: F.struct(*[m[f].alias(f) for f in fields]))

    d = d.withColumns(
        {
            "_m": F.coalesce(bare(F.col("m")), empty),
            **{f"_{flag}": bare(F.filter("m", _field_is_true(flag))) for flag in flags[:3]},
            "_o": F.coalesce("o", empty),
            "_t": F.coalesce("t", empty),
            "_prof": F.coalesce(F.col("p"), F.col("pf"), empty),
            "_top_counts": F.coalesce(
                F.try_element_at(F.filter("m", lambda m: m["f_specific"]), F.lit(1))["f_count"], F.lit(False)
            ),
        }
    )
    has_profile = F.size("_prof") > 0
    top_score = F.coalesce(F.try_element_at(F.col("_f_specific"), F.lit(1))["score"], F.lit(0.0))
    overview_or_matches = F.when(F.size("_o") > 0, F.col("_o")).otherwise(F.col("_m"))
    overview_score = F.coalesce(F.try_element_at(overview_or_matches, F.lit(1))["score"], F.lit(0.0))
    allow = F.coalesce(F.col("allow_overview"), F.lit(False))
    r = lx.REASONS

    def outcome(mode: str, confidence: Column | float, reason: str, rows_: Column) -> Column:
        c = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
        return F.struct(
            F.lit(mode).alias("mode"), c.cast("double").alias("confidence"), F.lit(reason).alias("reason"), rows_.alias("matches")
        )

    def first(array: Column) -> Column:
        return F.slice(array, 1, 1)

    def bounded(limit: int, base: int) -> Column:
        return F.least(F.lit(float(limit)), F.lit(base) + top_score * 2)

    none = outcome("fallback", 0, r["no_match"], empty)
    direct = F.when(F.col("q_count"), F.col("_top_counts")).otherwise(top_score >= 8)
    decision = (
        F.when(F.col("q_own_overview") & has_profile, outcome("direct", 94, r["overview"], first(F.col("_prof"))))
        .when(F.col("q_own_overview"), outcome("fallback", 0, r["overview_missing"], empty))
        .when(F.col("q_profile") & has_profile, outcome("direct", 94, r["direct"], first(F.col("_prof"))))
        .when(F.col("q_profile"), outcome("fallback", 0, r["profile_missing"], empty))
        .when(F.col("q_zero_to_one") & ~allow, outcome("fallback", 0, r["zero_to_one"], empty))
        .when(allow & F.col("q_scenario") & (F.size("_o") > 0), outcome("compose", 90, r["scenario"], F.col("_o")))
        .when(F.size("_m") == 0, none)
        .when(
            F.col("q_practice") & (F.size("_f_practice") > 0),
            outcome("compose", 88, r["practice"], F.col("_f_practice")),
        )
        .when(F.col("q_practice"), outcome("fallback", 0, r["practice_missing"], empty))
        .when(F.col("q_technology") & (F.size("_t") > 0), outcome("compose", 88, r["technology"], F.col("_t")))
        .when(F.size("_f_explicit") > 0, outcome("direct", 98, r["explicit"], first(F.col("_f_explicit"))))
        .when(
            allow & F.col("q_overview"),
            outcome(
                "compose", F.least(F.lit(80.0), F.lit(50) + overview_score * 2), r["project"], overview_or_matches
            ),
        )
        .when(F.size("_f_specific") == 0, outcome("fallback", 0, r["generic"], empty))
        .when(direct, outcome("direct", bounded(98, 70), r["direct"], first(F.col("_f_specific"))))
        .when(F.size("_f_specific") >= 2, outcome("compose", bounded(80, 50), r["compose"], F.col("_f_specific")))
        .otherwise(outcome("supplement", bounded(65, 35), r["supplement"], F.col("_f_specific")))
    )
    return d.select("query_id", decision.alias("_d")).select("query_id", "_d.*")


def select_evidence(
    routes: DataFrame, limit: int = lx.EVIDENCE_LIMIT, similarity: float = lx.EVIDENCE_SIMILARITY
) -> DataFrame:
    """``query_id, mode, reason, evidence``: reliable matches of direct and composed routes, else ``llm-only``."""
    supported = F.col("mode").isin("direct", "compose")
    reliable = F.filter(
        "matches",
        lambda m: m["match_type"].isin("keyword", "hybrid")
        | ((m["match_type"] == "semantic") & (F.coalesce(m["semantic_score"], F.lit(0.0)) >= similarity)),
    )
    kept = F.when(supported, F.slice(reliable, 1, limit)).otherwise(F.slice("matches", 1, 0))
    out = routes.select("query_id", kept.alias("evidence"))
    grounded = F.size("evidence") > 0
    return out.select(
        "query_id",
        F.when(grounded, "grounded").otherwise("llm-only").alias("mode"),
        F.when(grounded, lx.REASONS["grounded"]).otherwise(lx.REASONS["llm_only"]).alias("reason"),
        "evidence",
    )


def expand_siblings(
    matches: DataFrame, materials: DataFrame, key: Sequence[str] = SECTION_KEY, limit: int = lx.MATERIAL_LIMIT
) -> DataFrame:
    """Each match followed by the other chunks of its ``(source, project, title)``, distinct, at most ``limit``.

    ``matches``: ``query_id, rank`` and section columns. Early matches bring their siblings in before later matches,
    so a sibling can push out a later match.
    """
    group = ("source", "project", "title")
    m = matches.select("query_id", "rank", *key, *group)
    # Only groups that have a match are ranked.
    wanted = m.select(*group).distinct()
    s = materials.select(*key, *group).join(bounded_broadcast(wanted), list(group), "left_semi")
    # Siblings of a match beyond ``limit`` can never be kept, so a group is cut per title before it meets a question.
    per_group = Window.partitionBy(*group).orderBy(*key)
    near = s.withColumn("_n", F.row_number().over(per_group)).filter(F.col("_n") <= limit + 1).drop("_n")
    siblings = m.select("query_id", "rank", *group).join(near, list(group))
    listed = m.withColumn("_step", F.lit(0)).unionByName(siblings.withColumn("_step", F.lit(1)))
    position = F.struct("rank", "_step", *key)
    firsts = listed.groupBy("query_id", *key).agg(F.min(position).alias("_pos"), *[F.first(g).alias(g) for g in group])
    window = Window.partitionBy("query_id").orderBy("_pos")
    return firsts.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= limit).drop("_pos")


def assemble_context(matches: DataFrame, items: int = 4, chars: int = 2200, out: str = "context") -> DataFrame:
    """``query_id, context``: the first items in rank order, titled, clipped, joined by a blank line."""
    label = F.when(
        tx.text_or_empty("project") != "", F.concat(F.col("project"), F.lit(" / "), tx.text_or_empty("title"))
    ).otherwise(tx.text_or_empty("title"))
    block = F.concat(F.lit("【"), label, F.lit("】\n"), tx.clip("content", chars))
    kept = matches.filter(F.col("rank") <= items).select("query_id", F.struct("rank", block.alias("b")).alias("x"))
    gathered = kept.groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return gathered.select("query_id", F.array_join(F.transform("x", lambda x: x["b"]), "\n\n").alias(out))


def prompt_requests(
    questions: DataFrame,
    model: str,
    system: str = "",
    query: str = "query",
    stream: bool = True,
    thinking_off: bool = False,
) -> DataFrame:
    """``query_id, scope_label, user, request``: one request document per question for an external batch.

    ``questions`` has the query, ``scope``, ``context``, ``personal_context``, ``previous_context`` and ``template``.
    """
    limits = lx.PROMPT_LIMITS
    scope = F.when(F.col("scope").isin(*lx.SCOPES), F.col("scope")).otherwise("general")
    label = scope
    for name, text in lx.SCOPE_LABELS.items():
        label = F.when(scope == name, text).otherwise(label)
    previous = tx.clip("previous_context", limits["previous"])
    user = F.concat_ws(
        "\n\n",
        F.concat(F.lit("question: "), tx.text_or_empty(query)),
        F.concat(F.lit("scope: "), label),
        F.when(previous != "", F.concat(F.lit("previous:\n"), previous)),
        F.concat(F.lit("material:\n"), tx.text_or_empty("context")),
        F.concat(F.lit("background:\n"), tx.clip("personal_context", limits["personal"])),
        F.concat(F.lit("template:\n"), tx.clip("template", limits["template"])),
    )
    message = F.array(
        F.struct(F.lit("system").alias("role"), tx.clip(F.lit(system), limits["rules"]).alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("user").alias("content")),
    )
    fields = [
        F.lit(model).alias("model"),
        F.lit(lx.REQUEST_TEMPERATURE).alias("temperature"),
        F.lit(lx.REQUEST_MAX_TOKENS).alias("max_tokens"),
        message.alias("messages"),
    ]
    if stream:
        fields.append(F.lit(True).alias("stream"))
    if thinking_off:
        fields.append(F.struct(F.lit("disabled").alias("type")).alias("thinking"))
    rows = questions.select("query_id", label.alias("scope_label"), user.alias("user"))
    return rows.withColumn("request", F.to_json(F.struct(*fields)))


def write_requests(requests: DataFrame, path: str) -> None:
    """The request documents as JSON lines."""
    requests.select(F.col("request").alias("value")).write.mode("error").text(path)
