"""Queries over question features and lexical scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import features, lexical, lexical_index
from gleaner.plans import base
from gleaner.plans.registry import query, table
from gleaner.session import bounded_broadcast, scratch_folder

# Latin rule tables for the driver's prose.
STOP = ("the", "of", "and", "to", "de", "la")
SYNONYMS = ((r"(?i)thth", "that"), (r"(?i)ciones", "ción"))
GENERIC = r"^(?:Of|Outi).*"
INTENTS = (
    ("profile", r"(?i)eringen|rquell"),
    ("metric", r"(?i)theati|bleer"),
    ("count", r"(?i)ionen|ndhand"),
    ("fit", r"(?i)enst|ation"),
    ("challenge", r"(?i)ble"),
)
BONUS = (
    ("profile", "role", r"^profile$", 24),
    ("fit", "role", r"^profile$", 42),
    ("metric", "title", r"(?:ing|tion)", 60),
    ("metric", "text", r"(?:hethe|thing)", 10),
    ("count", "text", r"(?:ertion|ndth)", 18),
    ("challenge", "text", r"(?:Than|Éen)", 9),
)
CONCEPTS = (
    ("thing", ("thing", "inthe")),
    ("tion", ("tion", "cion")),
    ("ande", ("ande", "hand")),
    ("ment", ("ement", "menta")),
)
TITLE_STOP = ("that", "with")


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def tokens_sql(text: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), '\\s+'), "
        f"lambda w: length(w) > 1 AND w NOT IN {_list(STOP)})"
    )


def _case(rules, text: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{n}'" for n, p in rules) + f" ELSE '{default}' END"


def _concepts_sql(text: str) -> str:
    parts = []
    for concept, variants in CONCEPTS:
        test = " OR ".join(f"contains(lower({text}), '{v}')" for v in variants)
        parts.append(f"CASE WHEN {test} THEN '{concept}' END")
    return "list_filter([" + ", ".join(parts) + "], lambda c: c IS NOT NULL)"


_REWRITTEN = "regexp_replace(regexp_replace(text, '(?i)thth', 'that', 'g'), '(?i)ciones', 'ción', 'g')"
_TERM = "[a-z][a-z0-9_-]{1,}"
QUESTION_SQL = f"""
rewritten AS (SELECT item_id AS query_id, {_REWRITTEN} AS query FROM benchmark),
q AS (
  SELECT query_id, query, {tokens_sql("query")} AS q_tokens, {_case(INTENTS, "query", "general")} AS q_intent,
         {_concepts_sql("query")} AS q_concepts, list_distinct(regexp_extract_all(lower(query), '{_TERM}')) AS q_terms,
         list_filter(list_distinct(regexp_extract_all(lower(query), '{_TERM}')), lambda t: t NOT IN {_list(TITLE_STOP)}) AS q_title_terms
  FROM rewritten
  WHERE NOT regexp_matches(regexp_replace(query, '[\\s，,。！？?!]', '', 'g'), '{GENERIC}') AND len({tokens_sql("query")}) > 0)"""

#: chunk rows with the columns scoring reads
SCORED_SECTIONS_SQL = base.CHUNK_SQL + """,
s AS (
  SELECT doc_ord, section_ord, chunk_index, title, source, project, content,
         CASE WHEN project = 'de' THEN 'profile' ELSE 'general' END AS role,
         [lower(string_split(title, ' ')[1]) || ' extra', project] AS aliases
  FROM sections WHERE NOT regexp_matches(source, '^src19'))"""


def scored_sections(
    spark: SparkSession, sf_dir: str, only: DataFrame | None = None, parts=lexical.COMPONENTS, postings: DataFrame | None = None
) -> DataFrame:
    """All sections, laid out for scoring; or those of the documents in ``only``, to fetch the texts of matches.

    The SQL counts a title term once for each title that reads alike in lower case, hence ``title_forms`` where coverage is
    among the ``parts``. Where title phrases alone score, or nothing is asked, documents whose title no posting quotes are not
    cut into chunks.
    """
    if only is not None:
        return _with_names(base.chunk_sections(spark, sf_dir, only))
    docs = _with_names(base.document_sections(spark, sf_dir))
    if postings is not None and (tuple(parts) == ("phrase",) or postings.isEmpty()):
        docs = lexical.quoted_sections(docs, postings)
    elif "coverage" in parts:
        docs = lexical.with_title_forms(docs, lexical.exclude_glossary(docs, "^src19"))
    return base.partitioned_chunks(spark, docs)


def _with_names(sections: DataFrame) -> DataFrame:
    return sections.withColumns(
        {
            "role": F.when(F.col("project") == "de", "profile").otherwise("general"),
            "aliases": F.array(
                F.concat(F.lower(F.element_at(F.split("title", " "), 1)), F.lit(" extra")), F.col("project")
            ),
        }
    )


def question_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = features.question_features(
        base.questions(spark, sf_dir),
        synonyms=SYNONYMS,
        stop=STOP,
        generic=GENERIC,
        intents=INTENTS,
        groups=CONCEPTS,
    )
    return q.withColumn("q_title_terms", features.title_terms("query", TITLE_STOP))


def _feature(name: str, sql: str, value) -> None:
    @query(name, base.with_ctes(QUESTION_SQL, sql))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return question_features(spark, sf_dir).select("query_id", value())


@query(
    "document_tokens",
    f"SELECT doc_id, array_to_string({tokens_sql('text')}, ' ') AS tokens FROM documents",
)
def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(features.tokens("text", STOP), " ").alias("tokens")
    )


@query("query_synonyms", f"SELECT item_id AS query_id, {_REWRITTEN} AS query FROM benchmark")
def query_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = base.questions(spark, sf_dir)
    return q.withColumn("query", features.apply_synonyms("query", SYNONYMS))


_feature("query_generic_gate", "SELECT query_id, query FROM q", lambda: F.col("query"))
_feature(
    "query_concepts",
    "SELECT query_id, array_to_string(q_concepts, '|') AS concepts FROM q",
    lambda: F.array_join("q_concepts", "|").alias("concepts"),
)
_feature(
    "query_terms",
    "SELECT query_id, array_to_string(list_sort(q_terms), '|') AS terms FROM q",
    lambda: F.array_join(F.array_sort("q_terms"), "|").alias("terms"),
)


@query(
    "conversation_concepts",
    f"SELECT conv_id, turn, array_to_string({_concepts_sql('text')}, '|') AS concepts FROM conversations",
)
def conversation_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_join(features.concepts("text", CONCEPTS), "|").alias("concepts")
    )


@query(
    "conversation_intent",
    f"SELECT conv_id, turn, {_case(INTENTS, 'text', 'general')} AS intent FROM conversations",
)
def conversation_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", features.intent("text", INTENTS).alias("intent"))


_ANCHORS = ((r"(?i)theati", "one two"), (r"(?i)ionen", "three"), (r"(?i)enst", "four five"))


@query(
    "query_anchors",
    "SELECT item_id AS query_id, concat_ws(E'\\n', text, "
    + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{a}' END" for p, a in _ANCHORS)
    + ") AS query FROM benchmark",
)
def query_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = base.questions(spark, sf_dir)
    return q.withColumn("query", features.anchored_query("query", _ANCHORS))


@query(
    "exclude_glossary_sections",
    base.with_ctes(SCORED_SECTIONS_SQL, "SELECT doc_ord, chunk_index, source FROM s"),
)
def exclude_glossary_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lexical.exclude_glossary(base.chunk_sections(spark, sf_dir), "^src19")
    return s.select("doc_ord", F.col("chunk_index").cast("long").alias("chunk_index"), "source")


_BONUS_SQL = []
for _intent in dict.fromkeys(b[0] for b in BONUS):
    _arms = " ".join(
        "WHEN regexp_matches("
        + {"title": "title", "text": "concat_ws(' ', title, content)", "role": "role"}[field]
        + f", '{pattern}') THEN {points}"
        for name, field, pattern, points in BONUS
        if name == _intent
    )
    _BONUS_SQL.append(f"{{'intent': '{_intent}', 'points': CASE {_arms} ELSE 0 END}}")
_CONCEPT_POINTS = ", ".join(
    f"{{'concept': '{c}', 'points': CASE WHEN contains(title, '{c}') THEN 4 WHEN contains(content, '{c}') THEN 2 ELSE 0 END}}"
    for c, _ in CONCEPTS
)

#: the whole additive score, component by component, over every pair
PAIRS_SQL = (
    SCORED_SECTIONS_SQL
    + ","
    + QUESTION_SQL
    + rf""",
fields AS (
  SELECT doc_ord, chunk_index, unnest({tokens_sql("title")}) AS w, 3 AS p FROM s UNION ALL
  SELECT doc_ord, chunk_index, unnest({tokens_sql("array_to_string(aliases, ' ')")}), 2 FROM s UNION ALL
  SELECT doc_ord, chunk_index, unnest({tokens_sql("project")}), 2 FROM s UNION ALL
  SELECT doc_ord, chunk_index, unnest({tokens_sql("content")}), 1 FROM s),
tok AS (SELECT doc_ord, chunk_index, w, sum(p) AS p FROM fields GROUP BY ALL),
qtok AS (SELECT query_id, t, count(*) AS n FROM (SELECT query_id, unnest(q_tokens) AS t FROM q) GROUP BY ALL),
expansion AS (SELECT v.w, x.t FROM (SELECT DISTINCT w FROM tok) v JOIN (SELECT DISTINCT t FROM qtok) x ON contains(v.w, x.t)),
hit AS (SELECT doc_ord, chunk_index, t, least(4, sum(p)) AS pts FROM tok JOIN expansion USING (w) GROUP BY ALL),
direct AS (SELECT query_id, doc_ord, chunk_index, sum(pts * n) AS direct FROM hit JOIN qtok USING (t) GROUP BY ALL),
runs AS (
  SELECT doc_ord, chunk_index, w, max(p) AS p FROM (
    SELECT doc_ord, chunk_index, unnest(regexp_extract_all(lower(title), '[a-z0-9_-]+')) AS w, 16 AS p FROM s UNION ALL
    SELECT doc_ord, chunk_index, unnest(regexp_extract_all(lower(project), '[a-z0-9_-]+')), 12 FROM s UNION ALL
    SELECT doc_ord, chunk_index, unnest(regexp_extract_all(lower(content), '[a-z0-9_-]+')), 6 FROM s) GROUP BY ALL),
qterm AS (SELECT query_id, unnest(q_terms) AS t FROM q),
termx AS (SELECT v.w, x.t FROM (SELECT DISTINCT w FROM runs) v JOIN (SELECT DISTINCT t FROM qterm) x ON contains(v.w, x.t)),
termhit AS (SELECT doc_ord, chunk_index, t, max(p) AS pts FROM runs JOIN termx USING (w) GROUP BY ALL),
technical AS (SELECT query_id, doc_ord, chunk_index, sum(pts) AS technical FROM termhit JOIN qterm USING (t) GROUP BY ALL),
names AS (SELECT DISTINCT title, lower(concat_ws(' ', title, array_to_string(aliases, ' '))) AS names FROM s),
qtt AS (SELECT query_id, unnest(q_title_terms) AS t FROM q),
covered AS (SELECT query_id, names, count(*) AS c FROM names JOIN qtt ON contains(names, t) GROUP BY ALL),
coverage AS (
  SELECT query_id, doc_ord, chunk_index, CASE WHEN c >= 2 THEN c * 24 ELSE 0 END AS coverage
  FROM s JOIN covered ON covered.names = lower(concat_ws(' ', title, array_to_string(aliases, ' ')))),
phrase AS (
  SELECT query_id, doc_ord, chunk_index, 10 AS phrase FROM q JOIN s ON length(title) > 1 AND contains(query, title)),
concept AS (
  SELECT query_id, doc_ord, chunk_index, sum(x.points) AS concept
  FROM (SELECT doc_ord, chunk_index, unnest([{_CONCEPT_POINTS}]) AS x FROM s)
  JOIN (SELECT query_id, unnest(q_concepts) AS c FROM q) ON x.concept = c WHERE x.points > 0 GROUP BY ALL),
intent AS (
  SELECT query_id, doc_ord, chunk_index, x.points AS intent
  FROM (SELECT doc_ord, chunk_index, unnest([{", ".join(_BONUS_SQL)}]) AS x FROM s) JOIN q ON x.intent = q_intent
  WHERE x.points > 0),
keys AS (
  SELECT query_id, doc_ord, chunk_index FROM direct UNION SELECT query_id, doc_ord, chunk_index FROM technical
  UNION SELECT query_id, doc_ord, chunk_index FROM coverage UNION SELECT query_id, doc_ord, chunk_index FROM phrase
  UNION SELECT query_id, doc_ord, chunk_index FROM concept UNION SELECT query_id, doc_ord, chunk_index FROM intent),
scored AS (
  SELECT query_id, doc_ord, chunk_index, coalesce(direct, 0)::BIGINT AS direct, coalesce(phrase, 0)::BIGINT AS phrase,
         coalesce(coverage, 0)::BIGINT AS coverage, coalesce(technical, 0)::BIGINT AS technical,
         coalesce(concept, 0)::BIGINT AS concept, coalesce(intent, 0)::BIGINT AS intent
  FROM keys LEFT JOIN direct USING (query_id, doc_ord, chunk_index) LEFT JOIN phrase USING (query_id, doc_ord, chunk_index)
  LEFT JOIN coverage USING (query_id, doc_ord, chunk_index) LEFT JOIN technical USING (query_id, doc_ord, chunk_index)
  LEFT JOIN concept USING (query_id, doc_ord, chunk_index) LEFT JOIN intent USING (query_id, doc_ord, chunk_index)),
pairs AS (
  SELECT *, direct + phrase + coverage + technical + concept + intent AS score,
    CASE WHEN direct > 0 AND concept > 0 THEN 'hybrid' WHEN direct > 0 THEN 'keyword' ELSE 'semantic' END AS match_type
  FROM scored WHERE direct + phrase + coverage + technical + concept + intent > 0)"""
)


def pairs(spark: SparkSession, sf_dir: str, stop=STOP, parts=lexical.COMPONENTS, best=(), asked: DataFrame | None = None) -> DataFrame:
    """The scored pairs of all questions, or of those in ``asked``."""
    q = question_features(spark, sf_dir)
    if asked is not None:
        q = q.join(bounded_broadcast(asked.select("query_id").distinct()), "query_id", "left_semi")
    # Titles come from the documents, so this pass does not chunk anything.
    postings = lexical.materialise(lexical.question_postings(q, base.document_sections(spark, sf_dir)))
    s = lexical.exclude_glossary(scored_sections(spark, sf_dir, parts=parts, postings=postings), "^src19")
    scored = lexical.score_pairs(s, postings, stop=stop, groups=CONCEPTS, bonus=BONUS, partitioned=True, parts=parts, best=best)
    return scored.withColumn("chunk_index", F.col("chunk_index").cast("long"))


def _component(name: str, column: str) -> None:
    @query(
        name,
        base.with_ctes(
            PAIRS_SQL,
            f"""SELECT query_id, count(*) AS n, sum({column})::BIGINT AS total, max({column})::BIGINT AS most,
  sum({column} * (doc_ord % 1009 + 1) * (chunk_index + 1))::BIGINT AS placed FROM pairs WHERE {column} > 0 GROUP BY query_id""",
        ),
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Per question, sums over the sections that score; ``placed`` weighs each by where it stands."""
        p, c = pairs(spark, sf_dir, parts=(column,)).filter(F.col(column) > 0), F.col(column)
        place = (F.col("doc_ord") % 1009 + 1) * (F.col("chunk_index") + 1)
        return p.groupBy("query_id").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(c).cast("long").alias("total"),
            F.max(c).cast("long").alias("most"),
            F.sum(c * place).cast("long").alias("placed"),
        )


_component("lexical_direct_score", "direct")
_component("lexical_title_phrase", "phrase")
_component("lexical_title_coverage", "coverage")
_component("lexical_technical_terms", "technical")
_component("lexical_concept_score", "concept")
_component("lexical_intent_bonus", "intent")


@query(
    "lexical_match_type",
    base.with_ctes(
        PAIRS_SQL,
        "SELECT query_id, match_type, count(*) AS n, sum(score)::BIGINT AS total FROM pairs GROUP BY ALL",
    ),
)
def lexical_match_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = pairs(spark, sf_dir).groupBy("query_id", "match_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("score").cast("long").alias("total"))


@query(
    "lexical_top_k",
    base.with_ctes(
        PAIRS_SQL,
        """SELECT query_id, rank, doc_ord, chunk_index, score, match_type FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_ord, chunk_index) AS rank FROM pairs)
WHERE rank <= 12""",
    ),
)
def lexical_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = lexical.top_k(pairs(spark, sf_dir, best=[("score", 12)]), 12)
    return ranked.select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "doc_ord",
        "chunk_index",
        F.col("score").cast("long").alias("score"),
        "match_type",
    )


@query(
    "lexical_index_top_k",
    base.with_ctes(
        PAIRS_SQL,
        """SELECT query_id, rank, doc_ord, chunk_index, score, match_type FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_ord, chunk_index) AS rank FROM pairs)
WHERE rank <= 12""",
    ),
)
def lexical_index_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stored index: written first, then asked."""
    return indexed(spark, sf_dir, scratch_folder(spark)).matches.select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "doc_ord",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.col("score").cast("long").alias("score"),
        "match_type",
    )


def write_index(spark: SparkSession, sf_dir: str, path: str) -> lexical_index.Index:
    s = lexical.exclude_glossary(scored_sections(spark, sf_dir), "^src19")
    return lexical_index.write(s, path, stop=STOP, groups=CONCEPTS, bonus=BONUS)


def ask_index(spark: SparkSession, sf_dir: str, index: lexical_index.Index, k: int = 12) -> lexical_index.Found:
    q = question_features(spark, sf_dir)
    postings = lexical.materialise(lexical.question_postings(q, lexical_index.titles(index)))
    return lexical_index.search(index, postings, k)


def indexed(spark: SparkSession, sf_dir: str, path: str) -> lexical_index.Found:
    return ask_index(spark, sf_dir, write_index(spark, sf_dir, path))


@query(
    "benchmark_best_chunks",
    base.with_ctes(
        base.CHUNK_SQL,
        f"""q AS (SELECT item_id AS query_id, {tokens_sql("text")} AS q_tokens FROM benchmark),
tok AS (SELECT doc_ord, chunk_index, w, count(*) AS p
        FROM (SELECT doc_ord, chunk_index, unnest({tokens_sql("content")}) AS w FROM sections) GROUP BY ALL),
qtok AS (SELECT query_id, t, count(*) AS n FROM (SELECT query_id, unnest(q_tokens) AS t FROM q) GROUP BY ALL),
expansion AS (SELECT v.w, x.t FROM (SELECT DISTINCT w FROM tok) v JOIN (SELECT DISTINCT t FROM qtok) x ON contains(v.w, x.t)),
hit AS (SELECT doc_ord, chunk_index, t, least(4, sum(p)) AS pts FROM tok JOIN expansion USING (w) GROUP BY ALL),
direct AS (SELECT query_id, doc_ord, chunk_index, sum(pts * n)::BIGINT AS score FROM hit JOIN qtok USING (t) GROUP BY ALL)""",
        """SELECT query_id, rank, doc_ord, chunk_index, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_ord, chunk_index) AS rank FROM direct)
WHERE rank <= 5""",
    ),
)
def benchmark_best_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship slice: documents to chunks, benchmark passages to tokens, token hits, top five chunks per passage."""
    none = F.lit(None).cast("string")
    bare = base.partitioned_chunks(spark, base.document_sections(spark, sf_dir)).withColumns(
        {"title": none, "project": none, "role": none, "aliases": F.lit(None).cast("array<string>")}
    )
    q = base.questions(spark, sf_dir).withColumn("q_tokens", features.tokens("query", STOP))
    postings = lexical.materialise(lexical.token_postings(q))
    scored = lexical.score_pairs(
        bare, postings, stop=STOP, groups=(), bonus=(), partitioned=True, parts=("direct",), best=[("score", 5)]
    )
    ranked = lexical.top_k(scored, 5)
    return ranked.select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "doc_ord",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.col("score").cast("long").alias("score"),
    )
