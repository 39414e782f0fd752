"""Routing with every outcome: the documents' titles are asked as questions, with rules that fire on these texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.operators import routing
from gleaner.plans import base
from gleaner.plans.registry import query
from gleaner.session import materialise

_RULES = {
    "profile": (r"^(?:La|In)",),
    "own_overview": (r"^(?:Of|To)",),
    "practice": (r"(?i)ing", r"(?i)th|on"),
    "zero_to_one": (r"(?i)rere|nene",),
    "scenario": (r"(?i)an.{0,4}th", r"(?i)ver"),
    "technology": r"(?i)[a-z]ion",
    "count": r"(?i)ed|le",
    "overview": (r"(?i)^(?:Der|Is|And|En) ", r"(?i)ent"),
    "overview_veto": r"(?i)ento",
    "overview_always": r"(?i)^du ",
}
_META_TITLE, _META_TEXT = r"^(?:Que|Ung)", r"(?i)thingthe|eninin"
_EXPLICIT, _COUNTED, _PRACTICE = r"(?i)e", r"(?i)andes|tionth", r"(?i)ing the|ing of"
_OVERVIEW, _TECHNOLOGY = ((2, r"(?i)(?:ing|the) "), (1, r"(?i)er")), ((2, r"(?i)tion"), (1, r"^(?:De|Un|Ci)"))
_PROFILE = r"(?i)^to (?:th|an)|^la [a-l]"
_TAKEN, _ROUTED = 12, lx.ROUTED_RESULTS
_TERMS = "(?i)[a-z][a-z0-9_-]{1,}"


def _any(text: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '{p}')" for p in patterns) + ")"


def _reason(name: str) -> str:
    return "'" + lx.REASONS[name] + "'"


def _picked(name: str, rules, take: int, floor: int, doc: str, order: str) -> str:
    arms = " ".join(f"WHEN regexp_matches(title, '{p}') THEN {n}" for n, p in rules)
    return f"""{name} AS (SELECT query_id, list({{'doc': {doc}, 'score': greatest(score, {floor})}} ORDER BY priority DESC, {order}) AS l FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, {order}) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, title ORDER BY priority DESC, {order}) AS tn
    FROM (SELECT *, CASE {arms} END AS priority FROM tested WHERE NOT meta) WHERE priority IS NOT NULL) WHERE tn = 1)
  WHERE n <= {take} GROUP BY query_id)"""


def predicates_sql(source: str, name: str = "q") -> str:
    """``name``: the rows of ``source(query_id, query, …)`` with the predicates of the routing."""
    r = _RULES
    return f"""{name} AS (SELECT *, length(query) % 2 = 0 AS allow, {_any("d", r["own_overview"])} AS q_own, {_any("d", r["profile"])} AS q_profile,
  regexp_matches(d, '{r["practice"][0]}') AND regexp_matches(d, '{r["practice"][1]}') AS q_practice,
  {_any("d", r["zero_to_one"])} AS q_zero, {_any("d", r["scenario"])} AS q_scenario,
  regexp_matches(query, '{r["technology"]}') AS q_technology, regexp_matches(query, '{r["count"]}') AS q_count,
  (NOT regexp_matches(query, '{r["overview_veto"]}') AND {_any("query", r["overview"])}) OR regexp_matches(query, '{r["overview_always"]}') AS q_overview
  FROM (SELECT *, regexp_replace(query, '\\s+', '', 'g') AS d FROM {source}))"""


def tested_sql(source: str) -> str:
    """``tested``: candidates ``source(query_id, query, rank, title, project, content, …)`` with the flags of the routing."""
    return f"""tested AS (SELECT *, regexp_matches(title, '{_META_TITLE}') OR regexp_matches(title || E'\\n' || content, '{_META_TEXT}') AS meta,
  regexp_matches(title, '{_PROFILE}') AS profile, regexp_matches(concat_ws(E'\\n', title, content), '{_PRACTICE}') AS f_practice,
  len(regexp_extract_all(query, '{_TERMS}')) >= 1 AND regexp_matches(title, '{_EXPLICIT}') AND len(list_filter(
    regexp_extract_all(query, '{_TERMS}'), lambda t: NOT regexp_matches(title, '(?i)\\b' || t || '\\b'))) = 0 AS f_explicit,
  len(list_filter(regexp_extract_all(lower(query), '[a-z][a-z0-9_-]{{1,}}'), lambda t: NOT contains(low, t))) = 0
    AND len(list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda w: contains(low, w))) > 0 AS f_specific,
  regexp_matches(concat_ws(' ', title, content), '{_COUNTED}') AS f_count
  FROM (SELECT *, lower(concat_ws(' ', title, project, content)) AS low FROM {source}))"""


def _routes_sql() -> str:
    q = f"""titled AS (SELECT title, doc_ord, regexp_extract(content, '^\\s*\\S+\\s+\\S+\\s+(\\S+)', 1) AS third FROM docs WHERE title <> ''),
q0 AS (SELECT min(doc_ord) AS query_id, title, arg_min(third, doc_ord) AS third FROM titled GROUP BY title),
q1 AS (SELECT query_id, lower(split_part(regexp_replace(title, '\\s+', ' ', 'g'), ' ', 1)) AS word,
  CASE WHEN query_id % 2 = 0 THEN title ELSE title || ' ' || third END AS query FROM q0),
{predicates_sql("q1")}"""
    cand = f"""s AS (SELECT *, lower(split_part(regexp_replace(title, '\\s+', ' ', 'g'), ' ', 1)) AS word, length(content) % 13 AS score,
  ['keyword', 'hybrid', 'semantic'][1 + length(content) % 3] AS match_type FROM sections WHERE length(content) > 150),
best AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, doc_ord, chunk_index) AS rank FROM s QUALIFY rank <= {_TAKEN}),
asked AS (SELECT q.query_id, q.query, best.* FROM q JOIN best USING (word)),
{tested_sql("asked")}"""
    return ",\n".join([base.CHUNK_SQL, q, cand, decision_sql("doc_ord || '/' || chunk_index", "doc_ord, chunk_index")])


def decision_sql(doc: str, order: str, questions: str = "q") -> str:
    """``decided(query_id, d)``: the whole decision over ``questions`` and ``tested``; ``doc`` names a candidate, ``order`` is
    corpus order."""
    four = f"""four AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM tested WHERE NOT meta
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= {_ROUTED})"""
    item = f"{{'doc': {doc}, 'score': score}}"
    ranked = ", ".join(
        f"coalesce(list({item} ORDER BY rank) FILTER (f_{f}), []) AS l_{f}" for f in ("practice", "explicit", "specific")
    )
    agg = f"""agg AS (SELECT query_id, list({item} ORDER BY rank) AS m, {ranked}, arg_min(f_count, rank) FILTER (f_specific) AS top_count
  FROM four GROUP BY query_id),
prof AS (SELECT query_id, [arg_min({item}, rank)] AS l FROM tested WHERE profile GROUP BY query_id)"""
    o_or_m = "CASE WHEN len(o) > 0 THEN o ELSE m END"

    def arm(condition: str, mode: str, confidence: str, reason: str, rows: str) -> str:
        return f"WHEN {condition} THEN {{'mode': '{mode}', 'c': ({confidence})::DOUBLE, 'reason': {_reason(reason)}, 'l': {rows}}}"

    none = "l_none"
    arms = [
        arm("q_own AND len(p) > 0", "direct", "94", "overview", "p"),
        arm("q_own", "fallback", "0", "overview_missing", none),
        arm("q_profile AND len(p) > 0", "direct", "94", "direct", "p"),
        arm("q_profile", "fallback", "0", "profile_missing", none),
        arm("q_zero AND NOT allow", "fallback", "0", "zero_to_one", none),
        arm("allow AND q_scenario AND len(o) > 0", "compose", "90", "scenario", "o"),
        arm("len(m) = 0", "fallback", "0", "no_match", none),
        arm("q_practice AND len(l_practice) > 0", "compose", "88", "practice", "l_practice"),
        arm("q_practice", "fallback", "0", "practice_missing", none),
        arm("q_technology AND len(t) > 0", "compose", "88", "technology", "t"),
        arm("len(l_explicit) > 0", "direct", "98", "explicit", "l_explicit[1:1]"),
        arm("allow AND q_overview", "compose", f"least(80, 50 + 2 * ({o_or_m})[1].score)", "project", o_or_m),
        arm("len(l_specific) = 0", "fallback", "0", "generic", none),
        arm("CASE WHEN q_count THEN coalesce(top_count, false) ELSE l_specific[1].score >= 8 END", "direct",
            "least(98, 70 + 2 * l_specific[1].score)", "direct", "l_specific[1:1]"),
        arm("len(l_specific) >= 2", "compose", "least(80, 50 + 2 * l_specific[1].score)", "compose", "l_specific"),
        arm("true", "supplement", "least(65, 35 + 2 * l_specific[1].score)", "supplement", "l_specific"),
    ]
    empty = "[]::STRUCT(doc VARCHAR, score BIGINT)[]"

    def typed(column: str) -> str:
        return f"coalesce({column}::STRUCT(doc VARCHAR, score BIGINT)[], {empty})"

    decided = f"""decided AS (SELECT query_id, CASE {" ".join(arms)} END AS d FROM (SELECT q.*, {empty} AS l_none, {typed("agg.m")} AS m,
  {typed("agg.l_practice")} AS l_practice, {typed("agg.l_explicit")} AS l_explicit, {typed("agg.l_specific")} AS l_specific, top_count,
  {typed("prof.l")} AS p, {typed("ov.l")} AS o, {typed("te.l")} AS t
  FROM {questions} q LEFT JOIN agg USING (query_id) LEFT JOIN prof USING (query_id) LEFT JOIN ov USING (query_id) LEFT JOIN te USING (query_id)))"""
    picks = [_picked("ov", _OVERVIEW, 2, 20, doc, order), _picked("te", _TECHNOLOGY, 3, 18, doc, order)]
    return ",\n".join([four, agg, *picks, decided])


def _word(title: str) -> F.Column:
    return F.lower(F.split_part(F.regexp_replace(title, r"\s+", " "), F.lit(" "), F.lit(1)))


def title_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct title as a question; under an odd id with the word that follows it."""
    d = base.document_sections(spark, sf_dir).where("title <> ''")
    third = F.regexp_extract("content", r"^\s*\S+\s+\S+\s+(\S+)", 1)
    q = d.groupBy("title").agg(F.min("doc_ord").alias("query_id"), F.min_by(third, "doc_ord").alias("third"))
    asked = F.when(F.col("query_id") % 2 == 0, F.col("title")).otherwise(F.concat_ws(" ", "title", "third"))
    return q.select("query_id", _word("title").alias("word"), asked.alias("query")).withColumn(
        "allow_overview", F.length("query") % 2 == 0
    )


def title_candidates(spark: SparkSession, sf_dir: str, questions: DataFrame) -> DataFrame:
    """Sections whose title begins with the question's first word, the best twelve of each word. They are ranked before
    they meet the questions, so a common word doesn't multiply."""
    s = base.chunk_sections(spark, sf_dir).where(F.length("content") > 150).withColumns(
        {
            "word": _word("title"),
            "score": F.length("content") % 13,
            "match_type": F.element_at(F.array(*map(F.lit, ("keyword", "hybrid", "semantic"))), 1 + F.length("content") % 3),
            "semantic_score": F.lit(None).cast("double"),
        }
    )
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.col("score").desc(), "doc_ord", "chunk_index"))
    best = s.withColumn("rank", rank).where(F.col("rank") <= _TAKEN)
    best = best.withColumns({f"is_{name}": rule for name, rule in section_rules().items()})
    # All questions of a word have the same candidates, so those cut to an answer are known here.
    place = F.row_number().over(Window.partitionBy("word", "is_metadata").orderBy("rank"))
    best = best.withColumn("may_answer", ~F.col("is_metadata") & (place <= _ROUTED))
    return questions.select("query_id", "word", "query").join(best, "word").drop("word")


def section_rules() -> dict[str, F.Column]:
    """What the routing tests of a section alone."""
    return {
        "metadata": routing.is_metadata(title_rule=_META_TITLE, text_rule=_META_TEXT),
        "profile": F.col("title").rlike(_PROFILE),
        "practice": F.concat_ws("\n", "title", "content").rlike(_PRACTICE),
        "counted": routing.count_evidence(pattern=_COUNTED),
    }


def pair_rules(query: str) -> dict[str, F.Column]:
    """What it tests of a section and the question in column ``query``."""
    specific = routing.specific_evidence(query, routing.section_text(), keyword_fillers="\x00", keyword_terms="[a-z0-9]+")
    return {"explicit": routing.explicit_title(query, "title", _EXPLICIT), "specific": specific}


def decide(q: DataFrame, c: DataFrame, key=routing.SECTION_KEY, tested: bool = False) -> DataFrame:
    """The routes of questions ``q`` over candidates ``c``, both materialised; ``tested`` candidates have the rules' results
    as columns ``is_<rule>``."""
    rules = section_rules() | pair_rules("_query")
    if tested:
        rules = {name: F.col(f"is_{name}") for name in rules}
    picks = [
        routing.priority_pick(c, order, take, floor, key=key, metadata=rules["metadata"])
        for order, take, floor in ((_OVERVIEW, 2, 20), (_TECHNOLOGY, 3, 18))
    ]
    return routing.route(q, c.drop("query"), *picks, predicates=routing.question_predicates("query", **_RULES), **rules)


def title_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routes of all titles. Rules are tested where a question meets the sections that may answer it, and the texts go
    no further."""
    q = materialise(title_questions(spark, sf_dir))
    c = title_candidates(spark, sf_dir, q)
    c = c.withColumns({f"is_{name}": F.when(F.col("may_answer"), rule) for name, rule in pair_rules("query").items()})
    return decide(q, materialise(c.withColumn("content", F.lit(None).cast("string"))), tested=True)


def _keys(array: str) -> F.Column:
    return F.array_join(F.transform(array, lambda m: F.concat_ws("/", m["doc_ord"].cast("string"), m["chunk_index"].cast("string"))), ",")


@query(
    "route_title_questions",
    base.with_ctes(
        _routes_sql(),
        """SELECT query_id, d.mode AS mode, d.c AS confidence, d.reason AS reason,
  array_to_string(list_transform(d.l, lambda x: x.doc), ',') AS docs FROM decided""",
    ),
)
def route_title_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title's route. At sf0.01 all sixteen branches of the decision occur."""
    return title_routes(spark, sf_dir).select("query_id", "mode", "confidence", "reason", _keys("matches").alias("docs"))


@query(
    "title_evidence",
    base.with_ctes(
        _routes_sql(),
        """items AS (SELECT query_id, d.mode AS mode, d.reason AS reason, unnest(d.l).doc AS doc, generate_subscripts(d.l, 1) AS n FROM decided
  WHERE d.mode IN ('direct', 'compose')),
kept AS (SELECT i.*, row_number() OVER (PARTITION BY i.query_id ORDER BY n) AS rank FROM items i JOIN s ON s.doc_ord || '/' || s.chunk_index = i.doc
  LEFT JOIN ov ON ov.query_id = i.query_id LEFT JOIN te ON te.query_id = i.query_id
  WHERE match_type IN ('keyword', 'hybrid')
    OR (reason IN (""" + _reason("scenario") + ", " + _reason("project") + """) AND list_contains(list_transform(ov.l, lambda x: x.doc), i.doc))
    OR (reason = """ + _reason("technology") + """ AND list_contains(list_transform(te.l, lambda x: x.doc), i.doc)))""",
        """SELECT decided.query_id, CASE WHEN docs IS NULL THEN 'llm-only' ELSE 'grounded' END AS mode,
  CASE WHEN docs IS NULL THEN """ + _reason("llm_only") + " ELSE " + _reason("grounded") + f""" END AS reason, coalesce(docs, '') AS docs
FROM decided LEFT JOIN (SELECT query_id, string_agg(doc, ',' ORDER BY rank) AS docs FROM kept WHERE rank <= {lx.EVIDENCE_LIMIT} GROUP BY 1) USING (query_id)""",
    ),
)
def title_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = routing.select_evidence(title_routes(spark, sf_dir))
    return e.select("query_id", "mode", "reason", _keys("evidence").alias("docs"))


@query(
    "explicit_title_questions",
    base.with_ctes(_routes_sql(), "SELECT query_id, doc_ord, chunk_index::BIGINT AS chunk_index FROM tested WHERE f_explicit"),
)
def explicit_title_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = title_candidates(spark, sf_dir, title_questions(spark, sf_dir))
    hit = routing.explicit_title("query", "title", _EXPLICIT)
    return c.where(hit).select("query_id", "doc_ord", F.col("chunk_index").cast("long").alias("chunk_index"))
