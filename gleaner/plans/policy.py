"""Queries over glossary normalisation, turns, project context and eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import glossary, policy, turns
from gleaner.plans import base
from gleaner.plans.registry import query, table


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


# -- glossary ---------------------------------------------------------------------------------------------------------


def _glossary_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small glossary per part: its name with two alias lines (the last wins), and a term without aliases."""
    markdown = F.concat(
        F.lit("preface\n## "), "p_name", F.lit(" ##\n\nAliases: "), "p_type", F.lit("， none\n- aliases: "),
        F.col("p_partkey").cast("string"), F.lit(", "), "p_brand", F.lit("、\n## "), "p_type", F.lit("\nno aliases\n"),
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), markdown.alias("markdown"))


@query(
    "parse_glossary",
    """SELECT CAST(p_partkey AS VARCHAR) AS name, 0 AS ord, p_name AS term, p_partkey || '|' || p_brand AS aliases FROM part""",
)
def parse_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = glossary.parse_glossary(_glossary_documents(spark, sf_dir))
    return entries.select("name", F.col("ord").cast("long").alias("ord"), "term", F.array_join("aliases", "|").alias("aliases"))


@query(
    "merge_glossaries",
    """WITH up AS (SELECT p_name AS term, min(p_brand) AS alias, min(p_partkey) AS ord FROM part WHERE p_size < 10 GROUP BY 1),
built AS (SELECT p_name AS term, max(p_type) AS alias, min(p_partkey) AS ord FROM part GROUP BY 1)
SELECT term, alias AS aliases, 0 AS tier, ord FROM up
UNION ALL SELECT term, alias, 1, ord FROM built WHERE term NOT IN (SELECT term FROM up)""",
)
def merge_glossaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    up = p.filter("p_size < 10").groupBy(F.col("p_name").alias("term"))
    built = p.groupBy(F.col("p_name").alias("term"))
    merged = glossary.merge_glossaries(
        up.agg(F.array(F.min("p_brand")).alias("aliases"), F.min("p_partkey").alias("ord")),
        built.agg(F.array(F.max("p_type")).alias("aliases"), F.min("p_partkey").alias("ord")),
    )
    return merged.select("term", F.array_join("aliases", "|").alias("aliases"), F.col("tier").cast("long").alias("tier"), "ord")


_ENTRIES = (
    ("ALPHA", ("the thing", "thing", "les enan")),
    ("BETA", ("and the", "und die", "erthan")),
    ("GAMMA", ("tion-x", "ment.", "que la")),
    ("DELTA", ("hethe", "ountion", "nnn")),
)
#: the aliases above never overlap inside one text span except where a longer one holds a shorter one
_DICT_SQL = "t"
for _alias, _term in glossary.alias_order(_ENTRIES):
    _plain = all(ch.isascii() and (ch.isalnum() or ch == " ") for ch in _alias)
    _pat = _alias.replace(".", r"\.").replace("-", r"\-")
    if _plain:
        # No look-behind there: the character before is captured and put back; applied twice for adjacent hits.
        for _ in range(2):
            _DICT_SQL = (
                f"regexp_replace(regexp_replace({_DICT_SQL}, '(?i)(^|[^a-z0-9]){_pat}([^a-z0-9])', '\\1<{_term}>\\2', 'g'), "
                f"'(?i)(^|[^a-z0-9]){_pat}$', '\\1<{_term}>')"
            )
    else:
        _DICT_SQL = f"regexp_replace({_DICT_SQL}, '(?i){_pat}', '<{_term}>', 'g')"


@query(
    "normalise_terms",
    f"SELECT conv_id, turn, replace(replace({_DICT_SQL}, '<', ''), '>', '') AS body FROM (SELECT conv_id, turn, text AS t FROM conversations)",
)
def normalise_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).select("conv_id", "turn", glossary.normalise_terms("text", _ENTRIES).alias("body"))


@query(
    "normalise_terms_from_table",
    f"SELECT conv_id, turn, replace(replace({_DICT_SQL}, '<', ''), '>', '') AS body FROM (SELECT conv_id, turn, text AS t FROM conversations)",
)
def normalise_terms_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(term, list(aliases), 0, i) for i, (term, aliases) in enumerate(_ENTRIES)]
    dictionary = spark.createDataFrame(rows, "term string, aliases array<string>, tier int, ord int")
    texts = conversations(spark, sf_dir).select("conv_id", "turn", F.col("text").alias("body"))
    return glossary.normalise_with_table(texts, dictionary, "body", "conv_id")


_RULES = (
    ("(?i)tionen", "TION", "(?i)the", "(?i)que"),
    ("(?i)ment", "MENT", "(?i)elle", None),
    ("erer", "ER", None, "(?i)lich"),
)


def _context_sql(text: str) -> str:
    out = text
    steps = []
    for i, (pattern, replacement, require, veto) in enumerate(_RULES):
        source = f"t{i}"
        gate = " AND ".join(
            ([f"regexp_matches({source}, '{require}')"] if require else [])
            + ([f"NOT regexp_matches({source}, '{veto}')"] if veto else [])
        )
        steps.append((source, f"CASE WHEN {gate} THEN regexp_replace({source}, '{pattern}', '{replacement}', 'g') ELSE {source} END"))
    inner = f"SELECT conv_id, turn, {out} AS t0 FROM conversations"
    for i, (_, expression) in enumerate(steps):
        inner = f"SELECT conv_id, turn, {expression} AS t{i + 1} FROM ({inner})"
    return f"SELECT conv_id, turn, t{len(steps)} AS body FROM ({inner})"


@query("context_rules", _context_sql("text"))
def context_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = glossary.apply_context_rules("text", _RULES)
    return conversations(spark, sf_dir).select("conv_id", "turn", body.alias("body"))


_WHOLE = _context_sql("text").replace("AS body", "AS ruled")


@query(
    "normalise_questions",
    f"""SELECT conv_id, turn, replace(replace({_DICT_SQL}, '<', ''), '>', '') AS body FROM (
  SELECT conv_id, turn, trim(regexp_replace(regexp_replace(ruled, '^\\s+|\\s+$', '', 'g'), '\\s{{2,}}', ' ', 'g')) AS t FROM ({_WHOLE}))""",
)
def normalise_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context rules, blanks and the dictionary in one go, as a question goes through them."""
    whole = glossary.normalise_question("text", _ENTRIES, (), _RULES)
    return conversations(spark, sf_dir).select("conv_id", "turn", whole.alias("body"))


@query(
    "collapse_noise",
    r"""SELECT conv_id, turn, regexp_replace(regexp_replace(replace(text, '.', ' '), '^\s+|\s+$', '', 'g'), '\s{2,}', ' ', 'g') AS body
FROM conversations""",
)
def collapse_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = glossary.collapse_noise(F.replace("text", F.lit("."), F.lit(" ")))
    return conversations(spark, sf_dir).select("conv_id", "turn", body.alias("body"))


@query(
    "hot_words",
    """SELECT term, min(ord) AS ord FROM (
  SELECT trim(w) AS term, p_partkey AS ord FROM part, unnest(string_split(p_name || ' ' || p_type, ' ')) AS u(w))
WHERE term <> '' GROUP BY term""",
)
def hot_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select(
        F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("term"), F.col("p_partkey").alias("ord")
    )
    return glossary.hot_words(words)


# -- turns ------------------------------------------------------------------------------------------------------------

ENDINGS = ("the.", "on", "de.")
QUESTION_WORDS = r"(ing|que|lich)"
FOLLOW_UPS = (r"^(?:The|Of|La)[ .,]", r"^Th[^\n]*(?:re|on)$")


@query(
    "classify_turns",
    r"""SELECT conv_id, turn, complete, follow_up, CASE WHEN complete THEN 1200 ELSE 2200 END AS delay_ms FROM (
  SELECT conv_id, turn, NOT incomplete AND (follow_up OR regexp_matches(t, '(ing|que|lich)')) AS complete, follow_up FROM (
    SELECT *, ends_with(t, 'the.') OR ends_with(t, 'on') OR ends_with(t, 'de.') AS incomplete,
      regexp_matches(t, '^(?:The|Of|La)[ .,]') OR regexp_matches(t, '^Th[^\n]*(?:re|on)$') AS follow_up
    FROM (SELECT conv_id, turn, regexp_replace(trim(text), '[。！!]+$', '') AS t FROM conversations)))""",
)
def classify_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = turns.classify_turn("text", ENDINGS, QUESTION_WORDS, FOLLOW_UPS)
    rows = conversations(spark, sf_dir).select("conv_id", "turn", c.alias("c")).select("conv_id", "turn", "c.*")
    return rows.withColumn("delay_ms", F.col("delay_ms").cast("long"))


@query(
    "confirmed_questions",
    r"""SELECT conv_id, turn FROM (SELECT *, regexp_replace(trim(text), '[？?。！!]', '', 'g') AS t FROM conversations)
WHERE length(t) >= 120 OR regexp_matches(t, '^(In|La|De)')""",
)
def confirmed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = turns.is_confirmed("text", stock=r"^(In|La|De)", minimum=120)
    return conversations(spark, sf_dir).filter(keep).select("conv_id", "turn")


@query(
    "follow_up_context",
    r"""
WITH w AS (SELECT conv_id, turn, text, role, list({'q': text, 's': CASE WHEN role = 'user' THEN trim(role) ELSE '' END}) OVER (
  PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS p FROM conversations)
SELECT conv_id, turn, coalesce(array_to_string(list_transform(p, lambda x, i: '第 ' || i || ' 个前序问题：' || x.q ||
  CASE WHEN x.s <> '' THEN E'\n命中的原文：\n' || x.s ELSE '' END), E'\n\n'), '') AS context FROM w""",
)
def follow_up_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir).withColumn("source", F.when(F.col("role") == "user", F.col("role")))
    framed = turns.follow_up_context(rows, "conv_id", "turn", "text", "source")
    return framed.select("conv_id", "turn", "context")


@query(
    "display_cleanup",
    r"""SELECT conv_id, turn, regexp_replace(regexp_replace(trim(regexp_replace(replace(text, '.', '??'), '\s+', ' ', 'g')),
  '[？?]{2,}', '？', 'g'), '[！!]{2,}', '！', 'g') AS body FROM conversations""",
)
def display_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir).select("conv_id", "turn", F.replace("text", F.lit("."), F.lit("??")).alias("body"))
    return rows.withColumn("body", turns.clean_marks("body"))


@query(
    "display_form",
    r"""SELECT conv_id, turn, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')),
  '[\s，,。.、:：;；''"“”‘’()（）_-]+$', '') AS body FROM conversations""",
)
def display_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole display clean-up with Unicode folding and doubled sentences."""
    rows = conversations(spark, sf_dir).select("conv_id", "turn", F.concat("text", F.lit(" "), "text").alias("body"))
    return turns.clean_display(rows, "body")


_AROUND = r"[\x{4e00}-\x{9fff}，。！？?、\s]"


@query(
    "collapse_repeats",
    # Without look-around: separators are doubled, so that each side of a single letter has its own, and halved again.
    rf"""
WITH p AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(text), '\s{{2,}}', ' ', 'g'),
  'the(?:\s*the)+', 'the', 'g'), 'and(?:\s*and)+', 'and', 'g'), 'que(?:\s*que)+', 'que', 'g') AS t FROM conversations),
d AS (SELECT conv_id, turn, regexp_replace(regexp_replace(t, '({_AROUND})', '\1\1', 'g'),
  '(?i)({_AROUND})[a-z]({_AROUND})', '\1\2', 'g') AS t FROM p)
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(t, '({_AROUND}){_AROUND}', '\1', 'g'), '\s{{2,}}', ' ', 'g')) AS body FROM d""",
)
def collapse_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = ("the", "and", "que")
    return conversations(spark, sf_dir).select("conv_id", "turn", turns.collapse_repeats("text", phrases).alias("body"))


@query(
    "latest_question",
    r"""
WITH s AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(
  regexp_replace(text, '^[\s，,。！？?!]+|[\s，,。！？?!]+$', '', 'g'), '[.。]+'), lambda x: trim(x, E' \n')), lambda x: x <> '') AS p FROM conversations),
l AS (SELECT conv_id, turn, coalesce(p[-1], '') AS last FROM s),
c AS (SELECT *, list_filter(list_transform(range(2, length(last) + 1), lambda i: substr(last, i)),
  lambda x: regexp_matches(x, '^(?:the |que |die )') AND regexp_matches(trim(x), '(ing|on|er)')) AS tails FROM l)
SELECT conv_id, turn, coalesce(trim(tails[-1]), last) AS question FROM c""",
)
def latest_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = turns.latest_question(
        "text", starters=("the ", "que ", "die "), cue="(ing|on|er)", sentence_end="[.。]+", condition=r"^\z"
    )
    return conversations(spark, sf_dir).select("conv_id", "turn", q.alias("question"))


# -- projects and scope -------------------------------------------------------------------------------------------------

_NAME = "upper(substr(split_part(title, ' ', 1), 1, 1)) || lower(substr(split_part(title, ' ', 1), 2))"


def _named_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose project is the first word of the title."""
    d = base.document_sections(spark, sf_dir).withColumn("chunk_index", F.lit(0))
    return d.withColumns({"project": F.element_at(F.split("title", " "), 1), "inferred_project": F.lit("")})


_PROJECT_SQL = (
    base.SECTION_SQL
    + """,
named AS (SELECT doc_ord, split_part(title, ' ', 1) AS name FROM docs),
projects AS (SELECT lower(name) AS id, arg_min(name, doc_ord) AS name, min(doc_ord) AS ord FROM named WHERE name <> '' GROUP BY 1)"""
)


@query("project_options", base.with_ctes(_PROJECT_SQL, "SELECT id, name FROM projects"))
def project_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.project_options(_named_sections(spark, sf_dir)).select("id", "name")


@query(
    "project_sections",
    base.with_ctes(
        _PROJECT_SQL,
        "SELECT doc_ord FROM named WHERE lower(name) IN (SELECT id FROM projects WHERE length(id) = 4)",
    ),
)
def project_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _named_sections(spark, sf_dir)
    chosen = policy.project_options(s).filter(F.length("id") == 4)
    return policy.sections_for_projects(s, chosen).select("doc_ord")


_TURN_ID = "(conv_id * 1000 + turn)"
_EXPLICIT_SQL = (
    _PROJECT_SQL
    + f""",
asked AS (SELECT {_TURN_ID} AS query_id, conv_id, turn, text FROM conversations),
explicit AS (
  SELECT query_id, id AS explicit_id FROM (
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY length(name) DESC, ord) AS rn
    FROM asked JOIN projects ON contains(lower(text), id) WHERE length(id) >= 5) WHERE rn = 1)"""
)


def _turn_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversations(spark, sf_dir)
    return c.withColumns({"query_id": F.col("conv_id") * 1000 + F.col("turn"), "query": F.col("text")})


def _explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = policy.project_options(_named_sections(spark, sf_dir)).filter(F.length("id") >= 5)
    return policy.explicit_projects(_turn_questions(spark, sf_dir), projects, sizes=(5,))


@query("explicit_projects", base.with_ctes(_EXPLICIT_SQL, "SELECT query_id, explicit_id FROM explicit"))
def explicit_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explicit(spark, sf_dir)


_EXPERIENCE = (r"^(?:In|En|Des)", r"ereven")
_BARRIER = r"(?i)tionwh"
_FOLLOW = (r"^(?:Th|La|Die)",)
_CONTEXTUAL = r"(?i)ening"
_PRODUCT = (r"(?i)rely", r"(?i)lement")
_NAMED, _NAMED_Q, _DOMAIN = r"(?i)ounti", r"(?i)the", r"(?i)esth"

_RESOLVED_SQL = (
    _EXPLICIT_SQL
    + rf""",
flagged AS (SELECT a.*, explicit_id, regexp_matches(regexp_replace(text, '\s+', '', 'g'), '{_EXPERIENCE[0]}')
    OR regexp_matches(regexp_replace(text, '\s+', '', 'g'), '{_EXPERIENCE[1]}') AS experience,
  regexp_matches(trim(text), '{_FOLLOW[0]}') AS follow_up FROM asked a LEFT JOIN explicit USING (query_id)),
carried AS (SELECT *, last_value(CASE WHEN NOT experience THEN explicit_id END IGNORE NULLS) OVER (
  PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS active_id FROM flagged),
resolved AS (SELECT *,
  CASE WHEN explicit_id IS NOT NULL THEN explicit_id WHEN regexp_matches(text, '{_BARRIER}') THEN ''
       ELSE coalesce(active_id, '') END AS project_id,
  CASE WHEN explicit_id IS NOT NULL THEN 'explicit' WHEN regexp_matches(text, '{_BARRIER}') THEN 'unknown'
       WHEN active_id IS NOT NULL THEN 'context' ELSE 'unknown' END AS source,
  CASE WHEN explicit_id IS NOT NULL THEN 1.0 WHEN regexp_matches(text, '{_BARRIER}') THEN 0.0
       WHEN active_id IS NOT NULL THEN 0.7 ELSE 0.0 END::DOUBLE AS confidence FROM carried)"""
)


def resolved_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _turn_questions(spark, sf_dir).join(_explicit(spark, sf_dir), "query_id", "left")
    q = q.withColumns(
        {
            "experience": policy.is_experience("query", _EXPERIENCE),
            "follow_up": turns.is_follow_up("query", _FOLLOW),
        }
    )
    carried = policy.carry_project(q, "conv_id", "turn", "explicit_id", F.col("experience"))
    resolved = policy.resolve_context("query", "explicit_id", "active_id", barrier=_BARRIER)
    return carried.withColumn("resolved", resolved)


@query("carried_project", base.with_ctes(_RESOLVED_SQL, "SELECT conv_id, turn, active_id FROM resolved"))
def carried_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved_turns(spark, sf_dir).select("conv_id", "turn", "active_id")


@query(
    "resolved_context",
    base.with_ctes(_RESOLVED_SQL, "SELECT conv_id, turn, project_id, source, confidence FROM resolved"),
)
def resolved_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved_turns(spark, sf_dir).select("conv_id", "turn", "resolved.*")


@query(
    "scope_to_project",
    base.with_ctes(
        _RESOLVED_SQL,
        f"""SELECT conv_id, turn, project_id <> '' AND NOT experience AND (source = 'explicit' OR (source = 'context'
  AND (follow_up OR regexp_matches(text, '{_CONTEXTUAL}')))) AS scoped FROM resolved""",
    ),
)
def scope_to_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = policy.should_scope("resolved", "query", F.col("experience"), F.col("follow_up"), _CONTEXTUAL)
    return resolved_turns(spark, sf_dir).select("conv_id", "turn", scoped.alias("scoped"))


_SCOPE_SQL = (
    _RESOLVED_SQL
    + rf""",
scoped AS (SELECT *, CASE WHEN experience THEN 'experience' WHEN source = 'explicit' THEN 'project'
  WHEN (regexp_matches(d, '{_NAMED}') AND regexp_matches(d, '{_NAMED_Q}')) OR ((regexp_matches(d, '{_PRODUCT[0]}')
    OR regexp_matches(d, '{_PRODUCT[1]}')) AND NOT regexp_matches(d, '{_DOMAIN}')) THEN 'product'
  WHEN follow_up AND source <> '' THEN 'followup' ELSE 'general' END AS scope
  FROM (SELECT *, regexp_replace(text, '\s+', '', 'g') AS d FROM resolved))"""
)


def scoped_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolved_turns(spark, sf_dir)
    product = policy.is_external_product("query", _PRODUCT, _NAMED, _NAMED_Q, _DOMAIN)
    scope = policy.answer_scope(F.col("experience"), product, F.col("follow_up"), F.col("resolved.source"))
    return r.withColumn("scope", scope)


@query("answer_scope", base.with_ctes(_SCOPE_SQL, "SELECT conv_id, turn, scope FROM scoped"))
def answer_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoped_turns(spark, sf_dir).select("conv_id", "turn", "scope")


# -- eligibility --------------------------------------------------------------------------------------------------------

_FLAG_SQL = (
    base.SECTION_SQL
    + r""",
base AS (SELECT *, CASE WHEN regexp_matches(source, '^src1[0-4]') THEN true ELSE archive END AS arch,
                regexp_matches(title, '^(?:The|De)') AS is_profile
         FROM docs WHERE NOT regexp_matches(source, '^src19') AND project <> 'es'),
cur AS (SELECT source, max((NOT is_profile)::INT) AS np FROM base WHERE NOT arch GROUP BY source),
flags AS (SELECT doc_ord, source, title, arch, is_profile, arch AND cur.np IS NOT NULL AS superseded_all,
                 arch AND coalesce(cur.np, 0) = 1 AS superseded_np FROM base LEFT JOIN cur USING (source))"""
)


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = base.document_sections(spark, sf_dir).withColumn("chunk_index", F.lit(0))
    d = d.withColumns(
        {
            "archive": F.when(F.col("source").rlike("^src1[0-4]"), True).otherwise(F.col("archive")),
            "source_type": F.when(F.col("project") == "es", "skill").otherwise("knowledge"),
        }
    )
    return policy.section_flags(d, "^src19", profile=F.col("title").rlike("^(?:The|De)"))


@query(
    "superseded_sections",
    base.with_ctes(_FLAG_SQL, "SELECT doc_ord, is_profile, superseded_all, superseded_np FROM flags"),
)
def superseded_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).select("doc_ord", "is_profile", "superseded_all", "superseded_np")


@query(
    "eligible_sections",
    base.with_ctes(
        _FLAG_SQL,
        """SELECT scope, doc_ord FROM flags, (VALUES ('general'), ('project'), ('followup'), ('experience'), ('product')) v(scope)
WHERE (scope = 'experience' AND NOT superseded_all)
   OR (scope IN ('general', 'project', 'followup') AND NOT is_profile AND NOT superseded_np)""",
    ),
)
def eligible_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eligible rows of each of the five scopes, which is all a question's scope selects among."""
    scopes = F.explode(F.array(*map(F.lit, policy.lx.SCOPES)))
    return _flags(spark, sf_dir).withColumn("scope", scopes).filter(policy.is_eligible()).select("scope", "doc_ord")


# -- materials: every scope with every kind of question over all sections ----------------------------------------------

_KINDS = ("plain", "practice", "trend", "direct")
_ASKED = "the of and die que una"
_RICH = {"practice": r"and [a-z]+ing ", "trend": r" tion", "technology": r"^(?:En|La)"}
_ASKED_TITLE = r"(?i)th|de|qu"


def _materials(name: str, methodology: str) -> None:
    words = "|".join(_ASKED.split())

    @query(
        name,
        base.with_ctes(
            base.SECTION_SQL,
            rf"""b AS (SELECT *, regexp_matches(source, '^src1[0-4]') OR archive AS arch, regexp_matches(title, '^(?:The|De)') AS is_profile,
  regexp_matches(title || E'\n' || content, '{_RICH["practice"]}') AS practising,
  regexp_matches(title || E'\n' || content, '{_RICH["trend"]}') AS is_trend, regexp_matches(title, '{_RICH["technology"]}') AS is_technology
  FROM docs WHERE NOT regexp_matches(source, '^src19') AND project <> 'es')""",
            """cur AS (SELECT source, max((NOT is_profile)::INT) AS np FROM b WHERE NOT arch GROUP BY source)""",
            f"""f AS (SELECT b.*, arch AND np IS NOT NULL AS superseded_all, arch AND coalesce(np, 0) = 1 AS superseded_np,
  is_profile OR practising AS is_practice, regexp_matches(source, '{methodology}') AND NOT arch AS is_methodology,
  {_TITLE_SQL} AS t FROM b LEFT JOIN cur USING (source))""",
            """seen AS (SELECT bool_or(NOT superseded_all AND is_practice) AS practice,
  bool_or(NOT is_profile AND NOT superseded_np AND is_trend) AS trend,
  bool_or(NOT is_profile AND NOT superseded_np AND is_methodology) AS methodology FROM f)""",
            """c AS (SELECT DISTINCT source, t FROM f WHERE NOT is_profile AND NOT arch AND length(t) >= 4)""",
            rf"""r AS (SELECT s.scope, k.kind, f.*, seen.practice, seen.trend, seen.methodology,
  CASE WHEN scope = 'product' THEN false WHEN scope IN ('general', 'project', 'followup') THEN NOT is_profile AND NOT superseded_np
    ELSE NOT superseded_all END AS eligible,
  arch AND regexp_matches(title, '(?i)(^|[^A-Za-z0-9_])({words})([^A-Za-z0-9_]|$)') AND regexp_matches(title, '{_ASKED_TITLE}') AS answer,
  NOT EXISTS (SELECT 1 FROM c WHERE c.source = f.source AND length(f.t) >= 4 AND (contains(c.t, f.t) OR contains(f.t, c.t))) AS lone
  FROM f, seen, (SELECT unnest({list(policy.lx.SCOPES)}) AS scope) s, (SELECT unnest({list(_KINDS)}) AS kind) k)""",
            """e AS (SELECT *, scope = 'general' AND NOT is_profile AND answer AND lone AS explicit,
  scope IN ('project', 'followup') AND kind = 'direct' AND NOT is_profile AND arch AND (answer OR is_technology) AS again FROM r)""",
            """h AS (SELECT *, bool_or(explicit) OVER (PARTITION BY scope, kind) AS any_explicit FROM e)""",
            """o AS (SELECT *, CASE WHEN scope = 'experience' AND kind = 'practice' AND practice THEN eligible AND is_practice
  WHEN scope = 'general' AND kind = 'trend' AND trend THEN eligible AND is_trend
  WHEN scope = 'general' AND methodology THEN (eligible AND is_methodology) OR explicit
  WHEN scope = 'general' AND any_explicit THEN explicit ELSE eligible END AS once FROM h)""",
            """SELECT scope, kind, doc_ord, once::INT + again::INT AS copies FROM o WHERE once OR again""",
        ),
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = base.document_sections(spark, sf_dir).withColumns(
            {
                "chunk_index": F.lit(0),
                "archive": F.col("archive") | F.col("source").rlike("^src1[0-4]"),
                "source_type": F.when(F.col("project") == "es", "skill").otherwise("knowledge"),
            }
        )
        profile = F.col("title").rlike("^(?:The|De)")
        flags = policy.section_flags(d, "^src19", profile, methodology, **_RICH)
        asked = flags.withColumns(
            {
                "scope": F.explode(F.array(*map(F.lit, policy.lx.SCOPES))),
                "query": F.lit(_ASKED),
            }
        ).withColumn("kind", F.explode(F.array(*map(F.lit, _KINDS))))
        asked = asked.withColumn("query_id", F.concat_ws("-", "scope", "kind"))
        kinds = {f"{k}_question": F.col("kind") == k for k in _KINDS[1:]}
        kept = policy.select_materials(asked, flags, question_title=_ASKED_TITLE, **kinds)
        return kept.groupBy("scope", "kind", "doc_ord").agg(F.count(F.lit(1)).cast("int").alias("copies"))


_TITLE_SQL = r"lower(regexp_replace(title, '[^A-Za-z0-9\x{4e00}-\x{9fff}]', '', 'g'))"


_materials("answer_materials", "^none")
_materials("answer_materials_by_method", r"^src2\.")


@query(
    "archived_without_twin",
    base.with_ctes(
        _FLAG_SQL,
        f"""n AS (SELECT doc_ord, source, arch, {_TITLE_SQL} AS t FROM flags),
c AS (SELECT DISTINCT source, t FROM n WHERE NOT arch AND length(t) >= 4)""",
        """SELECT doc_ord FROM n WHERE arch AND NOT EXISTS (SELECT 1 FROM c WHERE c.source = n.source AND length(n.t) >= 4
  AND (contains(c.t, n.t) OR contains(n.t, c.t)))""",
    ),
)
def archived_without_twin(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _flags(spark, sf_dir)
    return policy.without_current_twin(f.filter("archive"), f.filter(~F.col("archive"))).select("doc_ord")


@query(
    "personal_context",
    base.with_ctes(
        _SCOPE_SQL,
        """ctx AS (SELECT '【' || title || E'】\\n' || content AS c FROM docs
  WHERE regexp_matches(title, '^(?:The|De)') ORDER BY doc_ord LIMIT 1)""",
        """SELECT conv_id, turn, scope, CASE WHEN scope IN ('experience', 'project', 'followup') THEN c ELSE '' END AS personal_context
FROM scoped, ctx""",
    ),
)
def personal_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = base.document_sections(spark, sf_dir).withColumn("chunk_index", F.lit(0))
    context = policy.personal_context(d, profile=F.col("title").rlike("^(?:The|De)"))
    return policy.add_personal_context(scoped_turns(spark, sf_dir).select("conv_id", "turn", "scope"), context)
