"""The whole answer job as one query: eligibility, lexical and vector candidates, fusion, route, evidence, context, prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.operators import fusion, lexical, routing, vectors
from gleaner.plans import base, retrieval, title_routing
from gleaner.plans import lexical as lexical_plans
from gleaner.plans.registry import query, table
from gleaner.session import materialise

_ITEMS, _CHARS = lx.CONTEXT_FULL
_TEMPLATE = "plain"

#: Sections of documents that aren't archived; a document's vector is the one of its id, a question's that of its item.
_JOB_SQL = (
    lexical_plans.PAIRS_SQL
    + """,
open_docs AS (SELECT doc_ord FROM docs WHERE NOT archive),
lex AS (SELECT query_id, rank, score, match_type, s.source, s.project, s.title, s.content, s.doc_ord, s.chunk_index FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_ord, chunk_index) AS rank FROM pairs
  WHERE doc_ord IN (SELECT doc_ord FROM open_docs)) p JOIN s USING (doc_ord, chunk_index) WHERE rank <= 12),
"""
    + retrieval._VEC_SQL.strip()
    .replace("SELECT vec_id AS query_id, e AS qe, sq AS qsq FROM n WHERE vec_id % 50 = 0", "SELECT q.query_id, e AS qe, sq AS qsq FROM n JOIN q ON q.query_id = vec_id")
    .replace("FROM probe, n WHERE query_id <> vec_id)", "FROM probe, n WHERE vec_id IN (SELECT doc_ord FROM s WHERE chunk_index = 0) AND vec_id IN (SELECT doc_ord FROM open_docs))")
    + """,
sem AS (SELECT query_id, rank, floor(sim * 10 + 0.5)::BIGINT AS score, 'semantic' AS match_type, sim AS semantic_score, s.source, s.project,
  s.title, s.content, s.doc_ord, s.chunk_index FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM cos WHERE sim > 0) p
  JOIN s ON s.doc_ord = p.vec_id AND s.chunk_index = 0 WHERE rank <= 20),
"""
    + retrieval._LISTS_SQL[retrieval._LISTS_SQL.index("gate AS") :]
    + """,
twelve AS (SELECT f.*, md5(concat_ws('|', source, project, title, content)) AS m, q.query FROM fused f JOIN q USING (query_id) WHERE rank <= 12),
bare AS (SELECT query_id, query FROM q),
"""
    + ",\n".join(
        [
            title_routing.predicates_sql("bare", "asked"),
            title_routing.tested_sql("twelve"),
            title_routing.decision_sql("m", "m", "asked"),
        ]
    )
    + f""",
items AS (SELECT query_id, d.mode AS mode, d.reason AS reason, unnest(d.l).doc AS m, generate_subscripts(d.l, 1) AS n FROM decided
  WHERE d.mode IN ('direct', 'compose')),
kept AS (SELECT i.query_id, f.m, f.title, f.project, f.content, row_number() OVER (PARTITION BY i.query_id ORDER BY n) AS rank
  FROM items i JOIN twelve f ON f.query_id = i.query_id AND f.m = i.m
  LEFT JOIN ov ON ov.query_id = i.query_id LEFT JOIN te ON te.query_id = i.query_id LEFT JOIN sk ON sk.query_id = f.query_id
    AND sk.source = f.source AND sk.project = f.project AND sk.title = f.title AND sk.content = f.content
  WHERE f.match_type IN ('keyword', 'hybrid') OR (f.match_type = 'semantic' AND sk.semantic_score >= {lx.EVIDENCE_SIMILARITY})
    OR (reason IN ({title_routing._reason("scenario")}, {title_routing._reason("project")}) AND list_contains(list_transform(ov.l, lambda x: x.doc), i.m))
    OR (reason = {title_routing._reason("technology")} AND list_contains(list_transform(te.l, lambda x: x.doc), i.m))),
grounded AS (SELECT query_id, string_agg(m, ',' ORDER BY rank) AS docs,
  string_agg('【' || CASE WHEN project <> '' THEN project || ' / ' ELSE '' END || title || E'】\\n' ||
    CASE WHEN length(trim(content)) > {_CHARS} THEN substr(trim(content), 1, {_CHARS}) || '…' ELSE trim(content) END, E'\\n\\n' ORDER BY rank) AS context
  FROM kept WHERE rank <= {min(lx.EVIDENCE_LIMIT, _ITEMS)} GROUP BY 1)"""
)


def _digest() -> F.Column:
    """Names a candidate by what makes it one."""
    return F.md5(F.concat_ws("|", *fusion.IDENTITY))


def fused_candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(fused, questions)``: the twelve best of lexical and vector candidates from documents that aren't archived."""
    q = materialise(lexical_plans.question_features(spark, sf_dir).select("query_id", "query"))
    docs = base.document_sections(spark, sf_dir).where("NOT archive")
    usable = materialise(lexical.exclude_glossary(docs, "^src19").select("doc_ord"))
    p = lexical_plans.pairs(spark, sf_dir).join(usable, "doc_ord", "left_semi")
    by_score = materialise(lexical.top_k(lexical.local_best(p, [("score", 12)], lexical.SECTION_KEY), 12))

    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = e.join(F.broadcast(q.select("query_id")), F.col("vec_id") == F.col("query_id"))
    stored = e.join(usable, F.col("vec_id") == F.col("doc_ord"), "left_semi")
    scored = vectors.similarities(asked.select("query_id", F.col("embedding").alias("query_vector")), stored, ["vec_id"])
    near = materialise(vectors.vector_top_k(scored, ["vec_id"], 20).withColumnRenamed("vec_id", "doc_ord"))

    wanted = by_score.select("doc_ord").unionByName(near.select("doc_ord")).distinct()
    s = materialise(
        lexical_plans.scored_sections(spark, sf_dir, only=wanted).select(
            "doc_ord", F.col("chunk_index").cast("long").alias("chunk_index"), "source", "project", "title", "content"
        )
    )
    columns = ["query_id", "rank", "score", "match_type", *fusion.IDENTITY]
    lex = by_score.join(s, ["doc_ord", "chunk_index"]).select(*columns)
    sem = near.join(s.where("chunk_index = 0"), "doc_ord").select(*columns, "semantic_score")
    return fusion.fuse(lex, sem, q), q


@query(
    "fuse_vector_candidates",
    base.with_ctes(
        _JOB_SQL,
        """SELECT query_id, rank, title, m, score, match_type, round(ranking_score, 9) AS ranking_score FROM twelve""",
    ),
)
def fuse_vector_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical hits fused with the hits of the vector search."""
    fused, _ = fused_candidates(spark, sf_dir)
    return fused.select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "title",
        _digest().alias("m"),
        F.col("score").cast("long").alias("score"),
        "match_type",
        F.round("ranking_score", 9).alias("ranking_score"),
    )


@query(
    "answer_job",
    base.with_ctes(
        _JOB_SQL,
        f"""SELECT query_id, d.mode AS mode, d.reason AS reason, CASE WHEN docs IS NULL THEN 'llm-only' ELSE 'grounded' END AS evidence_mode,
  coalesce(docs, '') AS docs, 'question: ' || query || E'\\n\\nscope: ' || '{lx.SCOPE_LABELS["general"]}' || E'\\n\\nmaterial:\\n' ||
  coalesce(context, '') || E'\\n\\nbackground:\\n' || E'\\n\\ntemplate:\\n{_TEMPLATE}' AS "user"
FROM decided JOIN bare USING (query_id) LEFT JOIN grounded USING (query_id)""",
    ),
)
def answer_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's route, evidence and prompt, from the tables to the text a model would get."""
    fused, q = fused_candidates(spark, sf_dir)
    c = materialise(fused.withColumn("digest", _digest()).withColumns({k: F.lit(None).cast("int") for k in lexical.SECTION_KEY}))
    asked = q.withColumn("allow_overview", F.length("query") % 2 == 0)
    routes = materialise(title_routing.decide(asked, c, ["digest"]))
    evidence = materialise(routing.select_evidence(routes))
    rows = evidence.select("query_id", F.posexplode("evidence").alias("at", "m"))
    rows = rows.select("query_id", (F.col("at") + 1).alias("rank"), "m.project", "m.title", "m.content")
    prompts = q.join(routing.assemble_context(rows, _ITEMS, _CHARS), "query_id", "left")
    parts = {"scope": "general", "personal_context": "", "previous_context": "", "template": _TEMPLATE}
    prompts = routing.prompt_requests(prompts.withColumns({k: F.lit(v) for k, v in parts.items()}), "m1")
    docs = F.array_join(F.transform("evidence", lambda m: F.md5(F.concat_ws("|", *[m[c] for c in fusion.IDENTITY]))), ",").alias("docs")
    found = evidence.select("query_id", F.col("mode").alias("evidence_mode"), docs)
    decided = routes.select("query_id", "mode", "reason").join(found, "query_id").join(prompts, "query_id")
    return decided.select("query_id", "mode", "reason", "evidence_mode", "docs", "user")
