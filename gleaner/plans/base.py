"""Corpora the registered queries share, as Spark plans and as SQL.

The driver tables hold Latin-script prose, so the plans pass Latin rule tables to the same operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import sectioning
from gleaner.plans.registry import table
from gleaner.session import bounded_broadcast

DELIMS = "。！？；!?;"


def with_ctes(*parts: str) -> str:
    """CTEs followed by the final SELECT."""
    *ctes, final = parts
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n" + final.strip()


def packed_sql(source: str, out: str, limit: int, delims: str = DELIMS) -> str:
    """CTEs turning ``source(doc_ord, section_ord, content, …)`` into ``out(doc_ord, section_ord, chunks)``."""
    state = "{'done': []::VARCHAR[], 'cur': ''}"
    flush = "CASE WHEN a.cur <> '' THEN list_append(a.done, a.cur) ELSE a.done END"
    final = "list_concat(r.done, CASE WHEN r.cur <> '' THEN [r.cur] ELSE []::VARCHAR[] END)"
    item = "{'done': []::VARCHAR[], 'cur': s}"
    return rf"""
{out}_para AS (
  SELECT doc_ord, section_ord, generate_subscripts(ps, 1) AS para, unnest(ps) AS p FROM (
    SELECT doc_ord, section_ord, list_filter(list_transform(regexp_split_to_array(content, '\n\s*\n'),
      lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS ps FROM {source})),
{out}_split AS (
  SELECT doc_ord, section_ord, para, CASE WHEN length(p) <= {limit} THEN [p] ELSE {final} END AS pieces FROM (
    SELECT *, list_reduce(list_prepend({state}, list_transform(
        CASE WHEN len(regexp_extract_all(p, '[^{delims}]+[{delims}]?')) = 0 THEN [p]
             ELSE regexp_extract_all(p, '[^{delims}]+[{delims}]?') END, lambda s: {item})),
      lambda a, b: CASE
        WHEN length(b.cur) > {limit} THEN {{'done': list_concat({flush}, list_transform(
             range(0, length(b.cur), {limit}), lambda o: substr(b.cur, o + 1, {limit}))), 'cur': ''}}
        WHEN length(a.cur) + length(b.cur) > {limit} THEN {{'done': {flush}, 'cur': b.cur}}
        ELSE {{'done': a.done, 'cur': a.cur || b.cur}} END) AS r FROM {out}_para)),
{out} AS (
  SELECT doc_ord, section_ord, {final} AS chunks FROM (
    SELECT doc_ord, section_ord, list_reduce(list_prepend({state}, list_transform(
        flatten(list(pieces ORDER BY para)), lambda s: {item})),
      lambda a, b: CASE WHEN a.cur = '' THEN {{'done': a.done, 'cur': b.cur}}
        WHEN length(a.cur) + length(b.cur) + 1 <= {limit} THEN {{'done': a.done, 'cur': a.cur || ' ' || b.cur}}
        ELSE {{'done': {flush}, 'cur': b.cur}} END) AS r
    FROM {out}_split GROUP BY doc_ord, section_ord))"""


TITLE = r"^\s*(\S+(?:\s+\S+){0,1})"

#: documents → one section per document, titled by its first two words.
SECTION_SQL = rf"""
docs AS (
  SELECT doc_id AS doc_ord, 0 AS section_ord, regexp_extract(text, '{TITLE}', 1) AS title, source || '.md' AS source,
         lang AS project, regexp_matches(text, '^[A-E]') AS archive, 'knowledge' AS source_type, text AS content
  FROM documents)"""

#: … cut to chunks; the columns every section-level oracle starts from.
CHUNK_SQL = (
    SECTION_SQL
    + ","
    + packed_sql("docs", "packed", 1600)
    + r""",
sections AS (
  SELECT d.doc_ord, d.section_ord, generate_subscripts(chunks, 1) - 1 AS chunk_index, len(chunks) AS chunk_count,
         d.title, d.source, d.project, d.archive, d.source_type, unnest(chunks) AS content
  FROM packed JOIN docs d USING (doc_ord, section_ord))"""
)


def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("doc_ord"),
        F.lit(0).alias("section_ord"),
        F.regexp_extract("text", TITLE, 1).alias("title"),
        F.concat("source", F.lit(".md")).alias("source"),
        F.col("lang").alias("project"),
        F.col("text").rlike("^[A-E]").alias("archive"),
        F.lit("knowledge").alias("source_type"),
        F.col("text").alias("content"),
    )


def chunk_sections(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Chunks of all documents, or of those whose ``doc_ord`` is in ``only``."""
    docs = document_sections(spark, sf_dir)
    if only is not None:
        docs = docs.join(bounded_broadcast(only.select("doc_ord").distinct()), "doc_ord", "left_semi")
    return sectioning.explode_chunks(docs)


def partitioned_chunks(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Chunks of documents that were hash-partitioned by ``doc_ord`` first, so chunking and scoring share one shuffle."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return sectioning.explode_chunks(documents.repartition(partitions, "doc_ord"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


#: pages → Markdown with headings, so that sectioning has something to find.
PAGE_STEPS = (
    (r"<(?:script|style)[^>]*>[^<]*</(?:script|style)>", ""),
    (r"<title[^>]*>([^<]*)</title>", "\n# \\1\n"),
    (r"<h1[^>]*>([^<]*)</h1>", "\n## \\1\n"),
    (r"<nav[^>]*>", "\n## Index nav\n"),
    (r"<article[^>]*>", "\n## Body the article\n"),
    (r"<li[^>]*>", "\n- "),
    (r"<p[^>]*>", "\n\n"),
    (r"<b>", "\n### part\n"),
    (r"<[^>]+>", ""),
)


def page_markdown_sql() -> str:
    out = "html"
    for pattern, replacement in PAGE_STEPS:
        out = f"regexp_replace({out}, '{pattern}', E'{replacement.replace(chr(92) + '1', chr(92) * 2 + '1').replace(chr(10), chr(92) + 'n')}', 'g')"
    return f"page_md AS (SELECT page_id, url AS name, {out} AS markdown FROM pages)"


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.col("html")
    for pattern, replacement in PAGE_STEPS:
        out = F.regexp_replace(out, pattern, replacement.replace("\\1", "$1"))
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("name"), out.alias("markdown"))
