"""Queries over routing, evidence and context assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import lexical, routing
from gleaner.plans import base
from gleaner.plans import lexical as lexical_plans
from gleaner.plans.registry import query, table

_PREDICATES = {
    "profile": (r"^(?:The|La)", r"erely"),
    "own_overview": (r"^Of",),
    "practice": (r"(?i)ing", r"(?i)hethe"),
    "zero_to_one": (r"(?i)rere",),
    "scenario": (r"(?i)onon[^\n]{0,24}the", r"(?i)keit[^\n]{0,10}ung"),
    "technology": r"(?i)(?:tion)[^\n]{0,22}(?:ble|ment)",
    "count": r"(?i)ndhe",
    "overview": (r"(?i)and[^\n]{0,14}ing", r"(?i)die[^\n]{0,16}ein"),
    "overview_veto": r"(?i)tiou",
    "overview_always": r"(?i)erha\s*the",
}


def _any(text: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '{p}')" for p in patterns) + ")"


@query(
    "question_predicates",
    f"""SELECT conv_id, turn, {_any("d", _PREDICATES["own_overview"])} AS q_own_overview, {_any("d", _PREDICATES["profile"])} AS q_profile,
  regexp_matches(d, '{_PREDICATES["practice"][0]}') AND regexp_matches(d, '{_PREDICATES["practice"][1]}') AS q_practice,
  {_any("d", _PREDICATES["zero_to_one"])} AS q_zero_to_one, {_any("d", _PREDICATES["scenario"])} AS q_scenario,
  regexp_matches(text, '{_PREDICATES["technology"]}') AS q_technology, regexp_matches(text, '{_PREDICATES["count"]}') AS q_count,
  (NOT regexp_matches(text, '{_PREDICATES["overview_veto"]}') AND {_any("text", _PREDICATES["overview"])})
    OR regexp_matches(text, '{_PREDICATES["overview_always"]}') AS q_overview
FROM (SELECT *, regexp_replace(text, '\\s+', '', 'g') AS d FROM conversations)""",
)
def question_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", *[p.alias(n) for n, p in routing.question_predicates("text", **_PREDICATES).items()])


_META_TITLE, _META_TEXT = r"^(?:Que|Ung)", r"(?i)thingthe|eninin"


@query(
    "drop_metadata_sections",
    base.with_ctes(
        base.CHUNK_SQL,
        f"""SELECT doc_ord, chunk_index FROM sections WHERE NOT (regexp_matches(title, '{_META_TITLE}')
  OR regexp_matches(title || E'\\n' || content, '{_META_TEXT}'))""",
    ),
)
def drop_metadata_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = base.chunk_sections(spark, sf_dir)
    kept = s.filter(~routing.is_metadata(title_rule=_META_TITLE, text_rule=_META_TEXT))
    return kept.select("doc_ord", F.col("chunk_index").cast("long").alias("chunk_index"))


_PRIORITY = ((4, r"^The"), (3, r"(?i)ing "), (2, r"^(?:De|Un)"), (1, r"tion"))


def _pick(name: str, take: int, floor: int) -> None:
    arms = " ".join(f"WHEN regexp_matches(title, '{p}') THEN {n}" for n, p in _PRIORITY)

    @query(
        name,
        base.with_ctes(
            base.SECTION_SQL,
            f"""p AS (SELECT *, CASE {arms} END AS priority FROM docs
  WHERE NOT (regexp_matches(title, '{_META_TITLE}') OR regexp_matches(title || E'\\n' || content, '{_META_TEXT}'))),
t AS (SELECT *, row_number() OVER (PARTITION BY source, title ORDER BY priority DESC, doc_ord) AS tn FROM p WHERE priority IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY priority DESC, doc_ord) AS rank FROM t WHERE tn = 1)""",
            f"""SELECT source AS query_id, rank, doc_ord, priority, greatest(length(title), {floor})::BIGINT AS score FROM r WHERE rank <= {take}""",
        ),
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = base.document_sections(spark, sf_dir).withColumns(
            {"query_id": F.col("source"), "score": F.length("title"), "chunk_index": F.lit(0)}
        )
        meta = routing.is_metadata(title_rule=_META_TITLE, text_rule=_META_TEXT)
        picked = routing.priority_pick(m, _PRIORITY, take, floor, metadata=meta)
        return picked.select(
            "query_id",
            F.col("rank").cast("long").alias("rank"),
            "doc_ord",
            F.col("priority").cast("long").alias("priority"),
            F.col("score").cast("long").alias("score"),
        )


_pick("overview_pick", 2, 20)
_pick("technology_pick", 3, 18)

_Q_TITLE = r"(?i)th|de"
_COUNT_EVIDENCE = r"(?i)andes|tionth"
_CANDIDATE_SQL = (
    lexical_plans.PAIRS_SQL
    + rf""",
cand AS (
  SELECT p.query_id, p.rank, p.doc_ord, p.chunk_index, p.score, p.match_type, s.source, s.project, s.title, s.content, q.query
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_ord, chunk_index) AS rank FROM pairs) p
  JOIN s USING (doc_ord, chunk_index) JOIN q USING (query_id) WHERE rank <= 12),
tested AS (SELECT *,
  len(regexp_extract_all(query, '(?i)[a-z][a-z0-9_-]{{1,}}')) >= 1 AND regexp_matches(title, '{_Q_TITLE}') AND
    len(list_filter(regexp_extract_all(query, '(?i)[a-z][a-z0-9_-]{{1,}}'),
      lambda t: NOT regexp_matches(title, '(?i)\b' || t || '\b'))) = 0 AS explicit,
  len(list_filter(regexp_extract_all(lower(query), '[a-z][a-z0-9_-]{{1,}}'), lambda t: NOT contains(low, t))) = 0
    AND len(list_filter(regexp_extract_all(replace(lower(query), 'zz', ' '), '[a-z0-9]+'), lambda w: contains(low, w))) > 0 AS specific,
  regexp_matches(concat_ws(' ', title, content), '{_COUNT_EVIDENCE}') AS counted,
  regexp_matches(title, '{_META_TITLE}') OR regexp_matches(title || E'\n' || content, '{_META_TEXT}') AS meta
  FROM (SELECT *, lower(concat_ws(' ', title, project, content)) AS low FROM cand))"""
)


def candidates(spark: SparkSession, sf_dir: str, asked: DataFrame | None = None) -> DataFrame:
    """Lexical top 12 per question, or per question in ``asked``, with the section columns and the question."""
    ranked = lexical.materialise(lexical.top_k(lexical_plans.pairs(spark, sf_dir, best=[("score", 12)], asked=asked), 12))
    s = lexical_plans.scored_sections(spark, sf_dir, only=ranked).select(
        "doc_ord", "section_ord", F.col("chunk_index").cast("long").alias("chunk_index"), "source", "project", "title", "content"
    )
    q = lexical_plans.question_features(spark, sf_dir).select("query_id", "query")
    return ranked.drop("section_ord").join(s, ["doc_ord", "chunk_index"]).join(q, "query_id")


def _specific(query: str) -> F.Column:
    return routing.specific_evidence(query, routing.section_text(), keyword_fillers="zz", keyword_terms="[a-z0-9]+")


@query("explicit_titles", base.with_ctes(_CANDIDATE_SQL, "SELECT query_id, doc_ord, chunk_index FROM tested WHERE explicit"))
def explicit_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a title states a question doesn't depend on scores, so sections are scored for the questions that one states."""
    q = lexical_plans.question_features(spark, sf_dir)
    stated = lexical.materialise(routing.stated_questions(q, base.document_sections(spark, sf_dir), _Q_TITLE))
    c = candidates(spark, sf_dir, stated).filter(routing.explicit_title("query", "title", _Q_TITLE))
    return c.select("query_id", "doc_ord", "chunk_index")


@query(
    "specific_evidence",
    base.with_ctes(_CANDIDATE_SQL, "SELECT query_id, doc_ord, chunk_index, specific FROM tested"),
)
def specific_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("query_id", "doc_ord", "chunk_index", _specific("query").alias("specific"))


@query(
    "count_evidence",
    base.with_ctes(
        base.CHUNK_SQL,
        f"SELECT doc_ord, chunk_index FROM sections WHERE regexp_matches(concat_ws(' ', title, content), '{_COUNT_EVIDENCE}')",
    ),
)
def count_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = base.chunk_sections(spark, sf_dir).filter(routing.count_evidence(pattern=_COUNT_EVIDENCE))
    return s.select("doc_ord", F.col("chunk_index").cast("long").alias("chunk_index"))


@query(
    "available_candidates",
    base.with_ctes(
        _CANDIDATE_SQL,
        """SELECT query_id, rank, doc_ord, chunk_index FROM (SELECT query_id, doc_ord, chunk_index,
  row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM cand WHERE project <> 'de') WHERE rank <= 4""",
    ),
)
def available_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    kept = routing.available_candidates(c, c.filter("project <> 'de'"))
    return kept.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_ord", "chunk_index")


_ROUTE_SQL = (
    _CANDIDATE_SQL
    + """,
four AS (SELECT * EXCLUDE (rank), rank FROM (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank
         FROM tested WHERE NOT meta) WHERE rank <= 4),
agg AS (SELECT query_id, count(*) AS n, arg_min(doc_ord, rank) FILTER (explicit) AS explicit_doc, count(*) FILTER (specific) AS ns,
  arg_min(score, rank) FILTER (specific) AS top, arg_min(counted, rank) FILTER (specific) AS top_counts,
  arg_min(doc_ord, rank) FILTER (specific) AS first_doc, list(doc_ord ORDER BY rank) FILTER (specific) AS docs FROM four GROUP BY 1),
decided AS (SELECT q.query_id, agg.*, regexp_matches(q.query, '(?i)ndhe') AS qcount,
  CASE WHEN coalesce(n, 0) = 0 THEN 5 WHEN explicit_doc IS NOT NULL THEN 8 WHEN coalesce(ns, 0) = 0 THEN 10
    WHEN CASE WHEN regexp_matches(q.query, '(?i)ndhe') THEN top_counts ELSE top >= 8 END THEN 11
    WHEN ns >= 2 THEN 12 ELSE 13 END AS outcome FROM q LEFT JOIN agg ON agg.query_id = q.query_id),
routes AS (SELECT query_id, CASE outcome WHEN 5 THEN 'fallback' WHEN 8 THEN 'direct' WHEN 10 THEN 'fallback' WHEN 11 THEN 'direct'
    WHEN 12 THEN 'compose' ELSE 'supplement' END AS mode,
  CASE outcome WHEN 5 THEN 0.0 WHEN 8 THEN 98.0 WHEN 10 THEN 0.0 WHEN 11 THEN least(98, 70 + 2 * top)
    WHEN 12 THEN least(80, 50 + 2 * top) ELSE least(65, 35 + 2 * top) END::DOUBLE AS confidence,
  CASE outcome WHEN 5 THEN '资料未命中' WHEN 8 THEN '命中原文直接答案' WHEN 10 THEN '只命中泛词，资料无法可靠回答'
    WHEN 11 THEN '资料直接回答核心问题' WHEN 12 THEN '需要整合多段资料' ELSE '资料相关但未覆盖核心问题' END AS reason,
  CASE outcome WHEN 8 THEN [explicit_doc] WHEN 11 THEN [first_doc] WHEN 12 THEN docs WHEN 13 THEN docs ELSE [] END AS docs
  FROM decided)"""
)


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("semantic_score", F.lit(None).cast("double"))
    q = lexical_plans.question_features(spark, sf_dir).select(
        "query_id", "query", F.lit(False).alias("allow_overview")
    )
    never = {name: F.lit(False) for name in ("q_own_overview", "q_profile", "q_practice", "q_zero_to_one", "q_scenario")}
    never.update({"q_technology": F.lit(False), "q_overview": F.lit(False), "q_count": F.col("query").rlike("(?i)ndhe")})
    return routing.route(
        q,
        c.drop("query"),
        query="query",
        predicates=never,
        metadata=routing.is_metadata(title_rule=_META_TITLE, text_rule=_META_TEXT),
        profile=F.lit(False),
        practice=F.lit(False),
        explicit=routing.explicit_title("_query", "title", _Q_TITLE),
        specific=_specific("_query"),
        counted=routing.count_evidence(pattern=_COUNT_EVIDENCE),
    )


def _doc_list(array: str):
    return F.array_join(F.transform(array, lambda m: m["doc_ord"].cast("string")), ",")


@query(
    "route_answers",
    base.with_ctes(_ROUTE_SQL, "SELECT query_id, mode, confidence, reason, array_to_string(docs, ',') AS docs FROM routes"),
)
def route_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _routes(spark, sf_dir)
    return r.select("query_id", "mode", "confidence", "reason", _doc_list("matches").alias("docs"))


@query(
    "select_evidence",
    base.with_ctes(
        _ROUTE_SQL,
        """k AS (SELECT r.query_id, f.doc_ord, f.rank FROM routes r JOIN four f ON f.query_id = r.query_id AND list_contains(r.docs, f.doc_ord)
  AND (r.mode <> 'direct' OR f.doc_ord = r.docs[1]) AND (r.reason <> '命中原文直接答案' OR f.explicit)
  AND (r.reason = '命中原文直接答案' OR f.specific)
  WHERE r.mode IN ('direct', 'compose') AND f.match_type IN ('keyword', 'hybrid')
  QUALIFY row_number() OVER (PARTITION BY r.query_id ORDER BY f.rank) <= CASE WHEN r.mode = 'direct' THEN 1 ELSE 3 END)""",
        """SELECT r.query_id, CASE WHEN count(k.doc_ord) > 0 THEN 'grounded' ELSE 'llm-only' END AS mode,
  coalesce(string_agg(k.doc_ord, ',' ORDER BY k.rank), '') AS docs FROM routes r LEFT JOIN k ON k.query_id = r.query_id GROUP BY 1""",
    ),
)
def select_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.select_evidence(_routes(spark, sf_dir)).select("query_id", "mode", _doc_list("evidence").alias("docs"))


@query(
    "expand_siblings",
    base.with_ctes(
        _CANDIDATE_SQL,
        """m AS (SELECT query_id, rank, doc_ord, chunk_index, source, project, title FROM cand WHERE rank <= 3),
listed AS (SELECT query_id, rank, 0 AS step, doc_ord, chunk_index FROM m UNION ALL
  SELECT query_id, rank, 1, s.doc_ord, s.chunk_index FROM m JOIN s ON s.source = m.source AND s.project = m.project AND s.title = m.title),
f AS (SELECT query_id, doc_ord, chunk_index, min((rank, step, doc_ord, chunk_index)) AS pos FROM listed GROUP BY ALL)""",
        """SELECT query_id, rank, doc_ord, chunk_index FROM (SELECT query_id, doc_ord, chunk_index,
  row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM f) WHERE rank <= 6""",
    ),
)
def expand_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = candidates(spark, sf_dir).filter(F.col("rank") <= 3)
    s = lexical.exclude_glossary(lexical_plans.scored_sections(spark, sf_dir), "^src19")
    s = s.withColumn("chunk_index", F.col("chunk_index").cast("long"))
    out = routing.expand_siblings(matches, s)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_ord", "chunk_index")


def _context_sql(items: int, chars: int) -> str:
    return f"""ctx AS (SELECT query_id, string_agg('【' || CASE WHEN project <> '' THEN project || ' / ' ELSE '' END || title || E'】\\n' ||
  CASE WHEN length(trim(content)) > {chars} THEN substr(trim(content), 1, {chars}) || '…' ELSE trim(content) END, E'\\n\\n' ORDER BY rank) AS context
  FROM cand WHERE rank <= {items} GROUP BY 1)"""


def _context(name: str, items: int, chars: int) -> None:
    @query(name, base.with_ctes(_CANDIDATE_SQL, _context_sql(items, chars), "SELECT query_id, context FROM ctx"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return routing.assemble_context(candidates(spark, sf_dir), items, chars)


_context("context_full", *routing.lx.CONTEXT_FULL)
_context("context_fast", *routing.lx.CONTEXT_FAST)
_context("context_follow_up", *routing.lx.CONTEXT_FOLLOW_UP)


@query(
    "prompt_requests",
    base.with_ctes(
        lexical_plans.QUESTION_SQL,
        """scoped AS (SELECT query_id, query, CASE WHEN contains(query, 'ing') THEN 'project' WHEN contains(query, 'que') THEN 'product'
    WHEN contains(query, 'die') THEN 'nonsense' ELSE 'general' END AS scope FROM q)""",
        """SELECT query_id, CASE scope WHEN 'project' THEN 'project' WHEN 'product' THEN '外部产品分析（禁止带入候选人经历、项目资料或 AI 技术方案）'
    ELSE '通用方法论（禁止带入个人经历或特定项目）' END AS scope_label, 'm1' AS model, 0.2::DOUBLE AS temperature, 900::BIGINT AS max_tokens,
  contains(query, 'the') AS has_previous FROM scoped""",
    ),
)
def prompt_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lexical_plans.question_features(spark, sf_dir).select("query_id", "query")
    scope = (
        F.when(F.contains("query", F.lit("ing")), "project")
        .when(F.contains("query", F.lit("que")), "product")
        .when(F.contains("query", F.lit("die")), "nonsense")
        .otherwise("general")
    )
    previous = F.when(F.contains("query", F.lit("the")), F.col("query"))
    q = q.withColumns(
        {
            "scope": scope,
            "context": F.col("query"),
            "personal_context": F.lit(""),
            "previous_context": previous,
            "template": F.lit("plain"),
        }
    )
    r = routing.prompt_requests(q, "m1", "rules")
    parsed = F.from_json("request", "model string, temperature double, max_tokens bigint")
    return r.select(
        "query_id", "scope_label", parsed.alias("r"), F.contains("user", F.lit("previous:\n")).alias("has_previous")
    ).select("query_id", "scope_label", "r.*", "has_previous")


def _clip_sql(text: str, limit: int) -> str:
    return f"CASE WHEN length(trim({text})) > {limit} THEN substr(trim({text}), 1, {limit}) || '…' ELSE trim({text}) END"


_LIMITS = routing.lx.PROMPT_LIMITS
_TEMPLATE = "Answer in order. " * 200
_PROMPT_SQL = f"""scoped AS (SELECT item_id AS query_id, text AS query, CASE WHEN contains(text, 'ing') THEN 'project'
  WHEN contains(text, 'que') THEN 'product' ELSE 'general' END AS scope, repeat(text, 3) AS previous, text || ' / ' || text AS context,
  lower(text) AS background FROM benchmark),
asked AS (SELECT query_id, 'question: ' || query || E'\\n\\nscope: ' || CASE scope WHEN 'project' THEN 'project'
    WHEN 'product' THEN '{routing.lx.SCOPE_LABELS["product"]}' ELSE '{routing.lx.SCOPE_LABELS["general"]}' END
  || E'\\n\\nprevious:\\n' || {_clip_sql("previous", _LIMITS["previous"])} || E'\\n\\nmaterial:\\n' || context
  || E'\\n\\nbackground:\\n' || {_clip_sql("background", _LIMITS["personal"])}
  || E'\\n\\ntemplate:\\n' || {_clip_sql(f"'{_TEMPLATE}'", _LIMITS["template"])} AS u FROM scoped)"""


@query(
    "prompt_texts",
    base.with_ctes(
        _PROMPT_SQL,
        f"""SELECT query_id, u AS "user", to_json({{'model': 'm1', 'temperature': {routing.lx.REQUEST_TEMPERATURE}::DOUBLE,
  'max_tokens': {routing.lx.REQUEST_MAX_TOKENS}, 'messages': [{{'role': 'system', 'content': 'Be brief.'}}, {{'role': 'user', 'content': u}}],
  'stream': true}})::VARCHAR AS request FROM asked""",
    ),
)
def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole prompts and requests, with every part and every limit in use."""
    q = base.questions(spark, sf_dir)
    scope = F.when(F.contains("query", F.lit("ing")), "project").when(F.contains("query", F.lit("que")), "product")
    q = q.withColumns(
        {
            "scope": scope.otherwise("general"),
            "context": F.concat_ws(" / ", "query", "query"),
            "personal_context": F.lower("query"),
            "previous_context": F.repeat("query", F.lit(3)),
            "template": F.lit(_TEMPLATE),
        }
    )
    return routing.prompt_requests(q, "m1", "Be brief.").select("query_id", "user", "request")
