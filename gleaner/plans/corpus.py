"""Queries over sources, sinks, sectioning, chunking and annotation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import session
from gleaner.functions import markup
from gleaner.functions import text as tx
from gleaner.operators import annotate, sectioning
from gleaner.plans import base
from gleaner.plans.registry import query, table
from gleaner.sources import documents as docs
from gleaner.sources import snapshot, vector_store


@query(
    "source_documents",
    "SELECT CAST(doc_id AS VARCHAR) AS name, text AS markdown, 'knowledge' AS type FROM documents",
)
def source_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.read_table_documents(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")


def _loose_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.when(F.col("source") != "src3", F.concat_ws("-", "source", "doc_id")).alias("name"),
        F.when(F.length("text") > 100, F.col("text")).alias("markdown"),
        F.when(F.col("lang") == "fr", "skill")
        .when(F.col("lang") == "es", "converter-skill")
        .when(F.col("lang") == "en", "knowledge")
        .alias("type"),
    )


_LOOSE = """loose AS (
  SELECT CASE WHEN source <> 'src3' THEN source || '-' || doc_id END AS name,
         CASE WHEN length(text) > 100 THEN text END AS markdown,
         CASE lang WHEN 'fr' THEN 'skill' WHEN 'es' THEN 'converter-skill' WHEN 'en' THEN 'knowledge' END AS type
  FROM documents)"""


@query(
    "valid_documents",
    base.with_ctes(
        _LOOSE,
        "SELECT name, markdown, coalesce(type, 'knowledge') AS type FROM loose "
        "WHERE name IS NOT NULL AND markdown IS NOT NULL",
    ),
)
def valid_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.valid_documents(_loose_documents(spark, sf_dir))


@query(
    "knowledge_documents",
    base.with_ctes(
        _LOOSE,
        "SELECT coalesce(name, '未命名资料') AS name, markdown, type FROM loose "
        "WHERE type IS NULL OR type NOT IN ('skill', 'converter-skill')",
    ),
)
def knowledge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.knowledge_documents(_loose_documents(spark, sf_dir))


@query(
    "latest_documents",
    """
WITH versions AS (SELECT substr(text, 1, 12) AS name, text AS markdown, doc_id AS version FROM documents),
toxic AS (SELECT DISTINCT substr(d.text, 1, 12) AS name FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1)
SELECT name, markdown, version FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY version DESC) AS rn FROM versions)
WHERE rn = 1 AND name NOT IN (SELECT name FROM toxic)""",
)
def latest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("name", F.substring("text", 1, 12))
    toxic = d.join(table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id").select("name")
    versions = d.select("name", F.col("text").alias("markdown"), F.col("doc_id").alias("version"))
    return docs.latest_documents(versions, toxic)


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select(
        F.substring("text", 1, 10).alias("name"),
        F.col("text").alias("markdown"),
        F.when(F.col("source").isin("src1", "src2", "src4"), "converter-skill").otherwise("knowledge").alias("type"),
        "n_chars",
    )
    current = d.filter("n_chars < 2000").drop("n_chars")
    return current, d.filter("n_chars >= 2000").drop("n_chars")


_HALVES = """d AS (
  SELECT substr(text, 1, 10) AS name, text AS markdown, n_chars,
         CASE WHEN source IN ('src1', 'src2', 'src4') THEN 'converter-skill' ELSE 'knowledge' END AS type FROM documents)"""


@query(
    "fill_missing_documents",
    base.with_ctes(
        _HALVES,
        """SELECT name, markdown, type FROM d WHERE n_chars < 2000 UNION ALL
           SELECT name, markdown, 'knowledge' FROM d
           WHERE n_chars >= 2000 AND name NOT IN (SELECT name FROM d WHERE n_chars < 2000)""",
    ),
)
def fill_missing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.fill_missing(*_halves(spark, sf_dir))


@query(
    "fill_missing_one_type",
    base.with_ctes(
        _HALVES,
        """SELECT name, markdown, type FROM d WHERE n_chars < 2000 UNION ALL
           SELECT name, markdown, type FROM d WHERE n_chars >= 2000 AND type = 'converter-skill'
             AND name NOT IN (SELECT name FROM d WHERE n_chars < 2000)""",
    ),
)
def fill_missing_one_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.fill_missing(*_halves(spark, sf_dir), only_type="converter-skill")


@query(
    "snapshot_round_trip",
    "SELECT source || '/' || doc_id AS name, text AS markdown, lang AS type FROM documents",
)
def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("  "), F.concat_ws("/", "source", "doc_id")).alias("name"),
        F.col("text").alias("markdown"),
        F.concat("lang", F.lit(" ")).alias("type"),
    )
    path = f"{session.checkpoint_root(spark)}/snapshot-{uuid.uuid4().hex}"
    snapshot.export_snapshot(path, d)
    return snapshot.restore_snapshot(spark, path)["documents"]


@query(
    "snapshot_violations",
    r"""
WITH t AS (SELECT trim(CASE WHEN source = 'src9' THEN ' ' ELSE substr(text, 1, 8) END, E' \n') AS name, text FROM documents)
SELECT name, CASE WHEN name = '' THEN 'blank name' ELSE 'duplicate name' END AS problem, count(*) AS n
FROM t GROUP BY name HAVING name = '' OR count(*) > 1""",
)
def snapshot_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    name = F.when(F.col("source") == "src9", " ").otherwise(F.substring("text", 1, 8))
    return snapshot.document_violations(d.select(name.alias("name"), F.col("text").alias("markdown")))


_KEYED = (
    base.CHUNK_SQL
    + """,
keyed AS (SELECT *, sha256(CAST(to_json([source, project, title, content, '']) AS VARCHAR)) AS section_key FROM sections)"""
)


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = base.chunk_sections(spark, sf_dir).withColumn("retrieval_text", F.lit(""))
    return s.withColumn("section_key", vector_store.section_key())


@query(
    "missing_vector_keys",
    base.with_ctes(
        _KEYED,
        """SELECT DISTINCT section_key FROM keyed WHERE section_key NOT IN (
             SELECT k.section_key FROM keyed k JOIN labels l ON l.doc_id = k.doc_ord WHERE l.quality = 1)""",
    ),
)
def missing_vector_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _keyed(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "doc_ord")
    version = F.when(F.col("quality") == 1, 3).otherwise(2)
    stored = keyed.join(labels, "doc_ord").select(
        "section_key", F.array(F.lit(1.0)).alias("embedding"), version.alias("model_version")
    )
    return vector_store.missing_sections(keyed, stored).select("section_key")


@query(
    "markup_plain_text",
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?i)<br\s*/?>', E'\n', 'g'), '(?i)<img[^>]*>', '[图示：原图信息请参考飞书原文]', 'g'), '<[^>]+>', '', 'g'),
  '(?i)&nbsp;', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g') AS body FROM pages""",
)
def markup_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", markup.plain_text("html").alias("body"))


_CELL = r"trim(regexp_replace(regexp_replace(regexp_replace({}, '<[^>]+>', '', 'g'), '(?i)&nbsp;', ' ', 'g'), '\s{{2,}}', ' ', 'g'))"


@query(
    "markup_tables",
    rf"""
WITH nav AS (SELECT page_id, html, regexp_extract(html, '<nav><ul>[\s\S]*?</ul></nav>') AS block FROM pages),
cells AS (SELECT *, list_transform(regexp_extract_all(block, '<li>([\s\S]*?)</li>', 1), lambda x: {_CELL.format("x")}) AS c FROM nav)
SELECT page_id, CASE WHEN block = '' THEN html ELSE replace(html, block, CASE WHEN len(list_filter(c, lambda x: x <> '')) = 0 THEN ''
  ELSE '| ' || array_to_string(c, ' | ') || E' |\n| ' || array_to_string(list_transform(c, lambda x: '---'), ' | ') || ' |' END)
  END AS body FROM cells""",
)
def markup_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigation lists rewritten as HTML tables, then to pipe tables in place."""
    html = F.regexp_replace("html", "<nav><ul>", "<table><tr>")
    html = F.regexp_replace(html, "</ul></nav>", "</tr></table>")
    html = F.regexp_replace(html, "<li>", "<td>")
    html = F.regexp_replace(html, "</li>", "</td>")
    return table(spark, sf_dir, "pages").select("page_id", markup.html_tables(html).alias("body"))


#: Lines that hold pipes, in runs; every one brings its divider (kept as a row but for a run's first) and a short row.
_PIPE_SQL = rf"""
WITH lines AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
               FROM (SELECT doc_id, string_split(text, E'\n') AS l FROM documents)),
marked AS (SELECT *, contains(line, '|') AS piped, pos - sum(contains(line, '|')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run
           FROM lines),
piped AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) AS nth,
  list_transform(string_split(regexp_replace(regexp_replace(trim('| ' || line || ' |'), '^\|', ''), '\|$', ''), '|'),
    lambda x: {_CELL.format("x")}) AS cells FROM marked WHERE piped),
drawn AS (SELECT doc_id, run, pos, k, cells FROM (
  SELECT doc_id, run, pos, nth, unnest([0, 1, 2]) AS k, unnest([cells, ['---', '---'], ['x']]) AS cells FROM piped) WHERE NOT (nth = 1 AND k = 1)),
wide AS (SELECT doc_id, run, max(len(cells)) AS w FROM drawn WHERE len(list_filter(cells, lambda x: x <> '')) > 0 GROUP BY ALL),
tables AS (
  SELECT doc_id, run, string_agg('| ' || array_to_string(list_concat(cells, list_transform(range(w - len(cells)), lambda x: '')), ' | ') || ' |'
    || CASE WHEN n = 1 THEN E'\n| ' || array_to_string(list_transform(range(w), lambda x: '---'), ' | ') || ' |' ELSE '' END, E'\n' ORDER BY n) AS body
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY pos, k) AS n FROM drawn JOIN wide USING (doc_id, run)
        WHERE len(list_filter(cells, lambda x: x <> '')) > 0) GROUP BY ALL),
pieces AS (SELECT doc_id, pos, line AS body FROM marked WHERE NOT piped
  UNION ALL SELECT doc_id, (SELECT min(pos) FROM piped p WHERE p.doc_id = t.doc_id AND p.run = t.run), body FROM tables t)
SELECT doc_id, string_agg(body, E'\n' ORDER BY pos) AS body FROM pieces GROUP BY doc_id"""


@query("markup_pipe_tables", _PIPE_SQL)
def markup_pipe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines that hold pipes, framed as table rows and re-padded."""
    framed = F.regexp_replace("text", r"(?m)^([^|\n]*\|[^\n]*)$", "| $1 |\n|---|---|\n| x |")
    return table(spark, sf_dir, "documents").select("doc_id", markup.pipe_tables(framed).alias("body"))


@query(
    "markup_record_lines",
    r"""
WITH lines AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
               FROM (SELECT doc_id, string_split(text, E'\n') AS l FROM documents)),
fields AS (SELECT doc_id, pos, string_split(replace(line, ',', '；'), '；') AS f FROM lines WHERE line <> '')
SELECT doc_id, pos, CASE WHEN len(list_filter(f, lambda x: trim(x) <> '')) = 0
  THEN '- 说明：原表格此行没有可读取文字。'
  ELSE array_to_string(list_transform(list_filter(f, lambda x: trim(x) <> ''), lambda x: '- 说明：' || trim(x)), E'\n')
  END AS body FROM fields""",
)
def markup_record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    record = F.concat(F.lit("- 记录 1："), F.regexp_replace("line", ",", "；"))
    return lines.filter("line <> ''").select(
        "doc_id", (F.col("p") + 1).cast("long").alias("pos"), markup.record_line(record).alias("body")
    )


_DIAGRAM_WORDS = r"[A-Za-z]\w*"


def _diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document as a chain of its words: the first word is a labelled node, the others are plain."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))

    def draw(words):
        chain = F.transform(
            F.filter(words, lambda _, i: i > 0),
            lambda w, i: F.concat(F.element_at(words, i + 1), F.lit(" --> "), w),
        )
        labels = F.transform(words, lambda w: F.concat(w, F.lit("["), F.upper(w), F.lit("]")))
        return F.array_join(F.concat(labels, chain), "\n")

    source = tx.let(F.regexp_extract_all("line", F.lit(_DIAGRAM_WORDS), 0), draw)
    return lines.select("doc_id", F.col("p").cast("long").alias("pos"), source.alias("diagram"))


_DIAGRAM_SQL = rf"""
words AS (SELECT doc_id, pos, regexp_extract_all(line, '{_DIAGRAM_WORDS}') AS w FROM (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, E'\n') AS l FROM documents)))"""


@query(
    "diagram_nodes",
    base.with_ctes(
        _DIAGRAM_SQL,
        "SELECT DISTINCT doc_id, pos, unnest(w) AS id, upper(unnest(w)) AS label FROM words",
    ),
)
def diagram_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _diagrams(spark, sf_dir)
    return d.select("doc_id", "pos", F.explode(markup.diagram_nodes(F.col("diagram"))).alias("n")).select(
        "doc_id", "pos", "n.id", "n.label"
    )


@query(
    "diagram_edges",
    base.with_ctes(
        _DIAGRAM_SQL,
        """SELECT doc_id, pos, edge, w[edge] AS src, w[edge + 1] AS dst FROM (
             SELECT doc_id, pos, w, unnest(range(1, len(w))) AS edge FROM words)""",
    ),
)
def diagram_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _diagrams(spark, sf_dir)
    edges = d.select("doc_id", "pos", F.posexplode(markup.diagram_edges(F.col("diagram"))).alias("edge", "e"))
    return edges.select("doc_id", "pos", (F.col("edge") + 1).cast("long").alias("edge"), "e.src", "e.dst")


@query(
    "diagram_text",
    base.with_ctes(
        _DIAGRAM_SQL,
        """SELECT doc_id, pos, array_to_string(list_concat(['图示文字说明：'],
  list_transform(list_filter(w, lambda x, i: list_position(w, x) = i), lambda x: '- 节点：' || upper(x)),
  list_transform(range(1, len(w)), lambda i: '- 链路：' || upper(w[i]) || ' → ' || upper(w[i + 1]))), E'\\n') AS body FROM words""",
    ),
)
def diagram_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _diagrams(spark, sf_dir)
    return d.select("doc_id", "pos", markup.diagram_text(F.col("diagram")).alias("body"))


@query(
    "markup_titles_and_tags",
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(html, '<title[^>]*>\s*([^<]*?)\s*</title>', '# \1', 'g'),
    '(?i)</?(?:grid|column|callout|sheet)[^>]*>', '', 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', E'\n\n', 'g'), '\s+$', '')
  || E'\n' AS body FROM pages""",
)
def markup_titles_and_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", markup.normalise_markdown("html").alias("body"))


_ON, _OFF = r"Body", r"part"
_SECTION_LINES = (
    base.page_markdown_sql()
    + rf""",
lines AS (SELECT page_id, name, generate_subscripts(l, 1) AS pos, unnest(l) AS line
          FROM (SELECT page_id, name, string_split(markdown, E'\n') AS l FROM page_md)),
marks AS (SELECT *, regexp_matches(line, '^#{{1,6}}\s.') AS is_head,
                 length(regexp_extract(line, '^(#{{1,6}})', 1)) AS lvl,
                 trim(regexp_extract(line, '^#{{1,6}}\s+(.+?)\s*#*$', 1)) AS head FROM lines),
run AS (SELECT *, sum(is_head::INT) OVER w AS section_ord,
         last_value(CASE WHEN is_head AND lvl = 1 THEN head END IGNORE NULLS) OVER w AS project,
         last_value(CASE WHEN is_head AND regexp_matches(head, '{_ON}') THEN true
                         WHEN is_head AND regexp_matches(head, '{_OFF}') THEN false END IGNORE NULLS) OVER w AS archive
  FROM marks WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
page_sections AS (
  SELECT page_id, section_ord::BIGINT AS section_ord, coalesce(any_value(head) FILTER (is_head), any_value(name)) AS title,
    coalesce(any_value(lvl) FILTER (is_head), 1) AS level, coalesce(any_value(project), '') AS project,
    coalesce(any_value(archive), false) AS archive,
    trim(string_agg(trim(regexp_replace(line, '^\s*[-*+]\s+', '')), E'\n' ORDER BY pos) FILTER (NOT is_head), E' \n') AS content
  FROM run GROUP BY page_id, section_ord)"""
)


@query(
    "parse_sections",
    base.with_ctes(
        _SECTION_LINES,
        """SELECT page_id, section_ord, title, level, project, archive, content FROM page_sections WHERE content <> ''""",
    ),
)
def parse_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = sectioning.split_sections(base.page_markdown(spark, sf_dir), archive_on=_ON, archive_off=_OFF)
    return raw.select(
        "page_id",
        F.col("section_ord").cast("long").alias("section_ord"),
        "title",
        F.col("level").cast("long").alias("level"),
        "project",
        "archive",
        sectioning.section_content().alias("content"),
    ).filter("content <> ''")


def _fenced_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page bodies inside one fence, to exercise provenance lines, fences and question extraction."""
    d = base.page_markdown(spark, sf_dir)
    body = F.concat(F.lit("> source: page\n```\n"), F.regexp_replace("markdown", "(?m)^#+ ", ""), F.lit("\n```\n"))
    return d.select("page_id", "name", body.alias("markdown"))


_FENCED_SQL = base.page_markdown_sql() + r""",
lines AS (SELECT page_id, generate_subscripts(l, 1) AS pos,
                 trim(regexp_replace(unnest(l), '^\s*[-*+]\s+', '')) AS line
          FROM (SELECT page_id, string_split(regexp_replace(regexp_replace(markdown, '\n#+ ', E'\n', 'g'), '^#+ ', ''), E'\n') AS l
                FROM page_md))"""


@query(
    "drop_provenance_lines",
    base.with_ctes(
        _FENCED_SQL,
        "SELECT page_id, trim(string_agg(line, E'\\n' ORDER BY pos), E' \\n') AS content FROM lines GROUP BY page_id",
    ),
)
def drop_provenance_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = sectioning.split_sections(_fenced_pages(spark, sf_dir), provenance=r"^>[ \t]*source[：:]")
    return raw.select("page_id", sectioning.section_content().alias("content"))


@query(
    "fenced_answers",
    base.with_ctes(
        _FENCED_SQL,
        r"""q AS (SELECT *, regexp_matches(line, '^(?:The|Of|In|De|La|Die) .*') AS is_q FROM lines),
g AS (SELECT *, sum(is_q::INT) OVER (PARTITION BY page_id ORDER BY pos) AS grp FROM q)""",
        r"""SELECT page_id, title, content FROM (
  SELECT page_id, grp, any_value(line) FILTER (is_q) AS title,
         trim(coalesce(string_agg(line, E'\n' ORDER BY pos) FILTER (NOT is_q), ''), E' \n') AS content
  FROM g WHERE grp > 0 GROUP BY page_id, grp) WHERE content <> ''""",
    ),
)
def fenced_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = sectioning.split_sections(_fenced_pages(spark, sf_dir), provenance=r"^>[ \t]*source[：:]")
    qa = sectioning.fenced_answers(question=r"^(?:The|Of|In|De|La|Die) .*")
    return raw.select("page_id", F.explode(qa).alias("qa")).select("page_id", "qa.title", "qa.content")


@query(
    "chunk_documents",
    base.with_ctes(
        base.CHUNK_SQL, "SELECT doc_ord, chunk_index, chunk_count, content FROM sections"
    ),
)
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.chunk_sections(spark, sf_dir).select(
        "doc_ord",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.col("chunk_count").cast("long").alias("chunk_count"),
        "content",
    )


@query(
    "chunk_latin_sentences",
    base.with_ctes(
        base.SECTION_SQL,
        base.packed_sql("docs", "packed", 300, ".!?;"),
        """SELECT doc_ord, generate_subscripts(chunks, 1) - 1 AS chunk_index, unnest(chunks) AS content FROM packed""",
    ),
)
def chunk_latin_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sectioning.explode_chunks(base.document_sections(spark, sf_dir), limit=300, delimiters=".!?;")
    return cut.select("doc_ord", F.col("chunk_index").cast("long").alias("chunk_index"), "content")


@query(
    "chunk_rows",
    base.with_ctes(
        base.CHUNK_SQL,
        "SELECT doc_ord, chunk_index, chunk_count, title, source, concat_ws(' ', title, content) AS text FROM sections",
    ),
)
def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.chunk_sections(spark, sf_dir).select(
        "doc_ord",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.col("chunk_count").cast("long").alias("chunk_count"),
        "title",
        "source",
        "text",
    )


_LATIN = {
    "label": r"^(?:Th|De)",
    "opening": r"(?:about|the) (?:of|and)",
    "generic_source": r"^src1\d?$",
    "generic_project": r"^(?:es)$",
    "project_word": r"(?:en|fr)",
    "general": r"^(?:de)$",
}
_ROLE_RULES = (
    ("project-background", r"(?:tion of|ation de)"),
    ("project-solution", r"(?i)(?:thing|letre|und die)"),
    ("project-metric", r"(?:ing the|ment le)"),
)
_ALIAS_RULES = (
    (r"(?i)the", ("the one", "x", "about [the] one?")),
    (r"(?i)^[a-d]", ("early letters", "the one")),
)
_ANNOTATED = (
    base.CHUNK_SQL
    + rf""",
flags AS (SELECT *, regexp_matches(title, '{_LATIN["label"]}')
    OR regexp_matches(content, '{_LATIN["opening"]}') AS profile,
    regexp_replace(source, '\.(md|markdown|go)$', '') AS stem FROM sections),
inferred AS (SELECT *, CASE WHEN profile THEN ''
    WHEN project <> '' AND NOT regexp_matches(project, '{_LATIN["generic_project"]}')
      AND regexp_matches(project, '{_LATIN["project_word"]}') THEN project
    WHEN stem = '' OR regexp_matches(stem, '{_LATIN["generic_source"]}') OR regexp_matches(stem, '{_LATIN["generic_project"]}') THEN ''
    ELSE stem END AS inferred_project FROM flags),
roles AS (SELECT *, CASE WHEN profile THEN 'profile'
    WHEN regexp_matches(title || E'\n' || content, '{_ROLE_RULES[0][1]}') THEN 'project-background'
    WHEN regexp_matches(title || E'\n' || content, '{_ROLE_RULES[1][1]}') THEN 'project-solution'
    WHEN regexp_matches(title || E'\n' || content, '{_ROLE_RULES[2][1]}') THEN 'project-metric'
    WHEN inferred_project <> '' THEN 'project' ELSE 'general' END AS role,
  trim(regexp_replace(regexp_replace(title, '[：:？?。！!（）()\[\]]', ' ', 'g'), '\s+', ' ', 'g')) AS ctitle FROM inferred),
aliased AS (SELECT *, CASE WHEN role = 'profile' THEN 'personal' WHEN role = 'general' THEN 'general'
    WHEN inferred_project <> '' THEN 'project' WHEN regexp_matches(project, '{_LATIN["general"]}') THEN 'general'
    ELSE 'project' END AS card_scope,
  list_filter([ctitle,
    CASE WHEN regexp_matches(ctitle, '(?i)the') THEN 'the one' END,
    CASE WHEN regexp_matches(ctitle, '(?i)the') THEN 'about the one' END,
    CASE WHEN regexp_matches(ctitle, '(?i)^[a-d]') THEN 'early letters' END,
    CASE WHEN regexp_matches(ctitle, '(?i)^[a-d]') AND NOT regexp_matches(ctitle, '(?i)the') THEN 'the one' END],
    lambda a: a IS NOT NULL AND length(a) >= 2) AS aliases0 FROM roles),
annotated AS (SELECT *, list_filter(aliases0, lambda a, i: list_position(aliases0, a) = i) AS aliases FROM aliased)"""
)


def annotated_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = base.chunk_sections(spark, sf_dir)
    profile = annotate.is_profile(label=_LATIN["label"], opening=_LATIN["opening"])
    inferred = annotate.inferred_project(
        profile=profile,
        generic_source=_LATIN["generic_source"],
        generic_project=_LATIN["generic_project"],
        project_word=_LATIN["project_word"],
    )
    s = s.withColumn("profile", profile).withColumn("inferred_project", inferred)
    s = s.withColumn("role", annotate.section_role(F.col("profile"), F.col("inferred_project"), _ROLE_RULES))
    return s.withColumns(
        {
            "aliases": annotate.card_aliases(rules=_ALIAS_RULES),
            "card_scope": annotate.card_scope(general=_LATIN["general"]),
            "card_id": annotate.card_id(),
        }
    ).withColumn("retrieval_text", annotate.retrieval_text())


def _annotated(name: str, column: str, sql: str) -> None:
    @query(
        name,
        base.with_ctes(_ANNOTATED, f"SELECT doc_ord, chunk_index, {sql} AS {column} FROM annotated"),
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = F.array_join("aliases", "|").alias("aliases") if column == "aliases" else F.col(column)
        return annotated_sections(spark, sf_dir).select(
            "doc_ord", F.col("chunk_index").cast("long").alias("chunk_index"), value
        )


_annotated("section_project", "inferred_project", "inferred_project")
_annotated("section_profile", "profile", "profile")
_annotated("section_role", "role", "role")
_annotated("section_aliases", "aliases", "array_to_string(aliases, '|')")
_annotated("section_scope", "card_scope", "card_scope")
_COMPACT_SQL = r"trim(regexp_replace(regexp_replace({}, '[：:？?。！!（）()\[\]]', ' ', 'g'), '\s+', ' ', 'g'))"
_annotated(
    "section_card_id",
    "card_id",
    r"'card-' || lower(regexp_replace(concat_ws('-', substr("
    + _COMPACT_SQL.format("source")
    + ", 1, 80), CASE WHEN inferred_project <> '' THEN inferred_project ELSE project END, substr(ctitle, 1, 120), "
    + r"CAST(chunk_index AS VARCHAR)), '[^\p{L}\p{N}-]+', '-', 'g'))",
)
_PARTS = (
    "list_filter(list_concat([CASE WHEN inferred_project <> '' THEN inferred_project ELSE project END, ctitle], "
    "aliases, [" + _COMPACT_SQL.format("content") + "]), lambda v: length(v) >= 2)"
)
_annotated(
    "section_retrieval_text",
    "retrieval_text",
    f"array_to_string(list_filter({_PARTS}, lambda v, i: list_position({_PARTS}, v) = i), E'\\n')",
)


@query(
    "answer_excerpts",
    r"""SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(?:^|\n)\s*(?:Answer|The|Que|Die)\s+')
  THEN trim(regexp_replace(t, '(?s)^.*?(?:^|\n)\s*(?:Answer|The|Que|Die)\s+', ''), E' \n') ELSE t END AS excerpt
FROM (SELECT conv_id, turn, trim(text, E' \n') AS t FROM conversations)""",
)
def answer_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marker = r"(?:^|\n)\s*(?:Answer|The|Que|Die)\s+"
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", annotate.answer_excerpt("text", marker).alias("excerpt")
    )
