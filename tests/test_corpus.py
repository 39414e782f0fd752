"""Sectioning, chunking, markup, annotation, snapshots and vector keys on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.functions import markup
from gleaner.operators import annotate, sectioning
from gleaner.sources import documents, snapshot, vector_store

MARKDOWN = """preamble text
# 甲项目 ##
intro
- bullet
> 来源：x
```
# heading in fence
lone code line
RAG 怎么做？
answer one
> 来源：kept inside a fence
为什么？
```
after the fence
## 完整原文资料
old
## 空
## 当前飞书版本
new
# 乙
tail
"""


def parsed(spark, markdown, name="doc.md"):
    d = spark.createDataFrame([(name, markdown, "knowledge")], "name string, markdown string, type string")
    return sectioning.parse_sections(d).orderBy("section_ord", "item_ord", "chunk_index").collect()


def test_sections_carry_project_archive_and_fences(spark):
    rows = parsed(spark, MARKDOWN)
    assert [(r.title, r.level, r.project, r.archive, r.content) for r in rows] == [
        ("doc", 1, "", False, "preamble text"),
        ("甲项目", 1, "甲项目", False, "intro bullet"),
        ("RAG 怎么做？", 2, "heading in fence", False, "answer one > 来源：kept inside a fence"),
        ("完整原文资料", 2, "heading in fence", True, "old"),
        ("当前飞书版本", 2, "heading in fence", False, "new"),
        ("乙", 1, "乙", False, "tail"),
    ]


def test_unclosed_fence_carries_over_headings(spark):
    rows = parsed(spark, "# a\n```\nx\n# b\nWorkflow 流程有哪些\nyes\n```\nplain\n")
    assert [(r.title, r.content) for r in rows] == [("a", "x"), ("Workflow 流程有哪些", "yes")]


def test_questions_without_answers_fall_back_to_the_body(spark):
    rows = parsed(spark, "# a\n```\n什么？\n```\nbody\n")
    assert [(r.title, r.content) for r in rows] == [("a", "什么？ body")]


def one(spark, expr, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return row.select(expr.alias("o")).first().o


@pytest.mark.parametrize(
    ("text", "sizes"),
    [
        ("a" * 1600, [1600]),
        ("a" * 1601, [1600, 1]),
        ("a" * 1000 + "。" + "b" * 1000 + "。", [1001, 1001]),
        ("a" * 800 + "\n\n" + "b" * 799, [1600]),
        ("a" * 800 + "\n \n" + "b" * 800, [800, 800]),
        ("a" * 3300 + "!" + "b" * 10, [1600, 1600, 112]),
        ("！" * 1700, [1600, 100]),
        ("\n\n \n", []),
    ],
)
def test_chunk_sizes(spark, text, sizes):
    assert [len(c) for c in one(spark, sectioning.chunks("t"), t=text)] == sizes


def test_exotic_blanks(spark):
    assert one(spark, sectioning.chunks("t"), t="﻿ a　 b\t\nc  ") == ["a b c"]


def test_markup(spark):
    html = 'x <table><tr><th>H|1</th><th>a<br>b</th></tr><tr><td></td></tr><tr><td>1</td></tr></table> y'
    assert one(spark, markup.html_tables("t"), t=html) == "x | H\\|1 | a<br>b |\n| --- | --- |\n| 1 |  | y"
    assert one(spark, markup.pipe_tables("t"), t="| a |\n| b |\nz") == "| a |\n| b |\nz"
    assert one(spark, markup.pipe_tables("t"), t="q\n| a | b |\n|:--|---|\n| 1 |\nz") == (
        "q\n| a | b |\n| --- | --- |\n| 1 |  |\nz"
    )
    assert one(spark, markup.record_line("t"), t="- 记录 2：名称：甲；空：；备注") == "- 名称：甲\n- 说明：备注"
    assert one(spark, markup.record_line("t"), t="- 记录 2：；") == "- 说明：原表格此行没有可读取文字。"
    diagram = "A[Start] --> B\nB[End]\nA[Again]\nA ==> C"
    assert one(spark, markup.diagram_text(F.col("t")), t=diagram) == (
        "图示文字说明：\n- 节点：Again\n- 节点：End\n- 链路：Again → C"
    )
    assert one(spark, markup.plain_text("t"), t="a<br/>b<img src=x>&nbsp;<i>c</i>\n\n\n\nd") == (
        "a\nb[图示：原图信息请参考飞书原文] c\n\nd"
    )


def test_whole_normalisation(spark):
    raw = (
        "<title>T <b>x</b></title>\r\n```plaintext\nkept\n```\n<callout>c</callout>  \n"
        '<whiteboard token="k1"></whiteboard>\n```json\n{"a":1}\n```\n\n\n\n```mermaid\nA[x] --> B[y]\n```\n\n'
    )
    assert one(spark, markup.normalise_markdown("t"), t=raw) == (
        "# T x\nkept\n\nc\n> 图示：飞书画板（原文资源标识：`k1`）。图中可读取链路请以相邻标题和正文为准。\n"
        '{"a":1}\n\n图示文字说明：\n- 节点：x\n- 节点：y\n'
    )


def test_annotation(spark):
    rows = [
        ("s.md", "自我介绍", "", "hello", 0),
        ("面试知识库-甲.md", "RAG：设计？", "甲平台", "text", 1),
        ("通用资料.md", "指标", "", "口径", 0),
    ]
    s = spark.createDataFrame(rows, "source string, title string, project string, content string, chunk_index int")
    got = {r.title: r for r in annotate.annotate(s).collect()}
    assert (got["自我介绍"].role, got["自我介绍"].card_scope, got["自我介绍"].inferred_project) == ("profile", "personal", "")
    rag = got["RAG：设计？"]
    assert (rag.inferred_project, rag.role, rag.card_scope) == ("甲平台", "project-solution", "project")
    assert rag.aliases == ["RAG 设计", "RAG 是什么", "RAG 怎么做", "RAG 方案怎么设计", "检索增强生成怎么做"]
    assert rag.card_id == "card-面试知识库-甲-md-甲平台-rag-设计-1"
    assert rag.retrieval_text.split("\n") == ["甲平台", *rag.aliases, "text"]
    assert (got["指标"].role, got["指标"].inferred_project) == ("project-metric", "")


def test_answer_excerpt(spark):
    assert one(spark, annotate.answer_excerpt("t"), t="题目\n**回答：** first\n回答：second") == "first\n回答：second"
    assert one(spark, annotate.answer_excerpt("t"), t=" none ") == "none"


def test_document_tables(spark, tmp_path):
    (tmp_path / "store.json").write_text('[{"name": "a", "markdown": "x"}, {"name": "b", "type": "skill"}]')
    d = documents.valid_documents(documents.read_json_documents(spark, str(tmp_path / "store.json")))
    assert [tuple(r) for r in d.collect()] == [("a", "x", "knowledge")]
    (tmp_path / "n.md").write_text("# t\nline")
    files = documents.read_markdown_files(spark, str(tmp_path / "n.md"), "skill")
    assert [tuple(r) for r in files.collect()] == [("n.md", "# t\nline", "skill")]
    assert documents.knowledge_documents(files).count() == 0


def test_snapshot_gate(spark, tmp_path):
    schema = "name string, markdown string, type string"
    good = spark.createDataFrame([(" a ", "x", " "), ("b", "y", "skill")], schema)
    rules = spark.createDataFrame([("r", "text")], "name string, markdown string")
    snapshot.export_snapshot(str(tmp_path / "s"), good, rules=rules, preferences={"active_project_id": " p "})
    back = snapshot.restore_snapshot(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, back["documents"].collect())) == [("a", "x", "knowledge"), ("b", "y", "skill")]
    assert back["glossary"] is None and back["preferences"]["active_project_id"] == "p"
    bad = spark.createDataFrame([("a", "x", None), (" a", "y", None)], schema)
    with pytest.raises(snapshot.SnapshotError):
        snapshot.export_snapshot(str(tmp_path / "t"), bad)
    spark.range(1).selectExpr("2 as schema_version").write.json(str(tmp_path / "u" / "manifest"))
    with pytest.raises(snapshot.SnapshotError):
        snapshot.restore_snapshot(spark, str(tmp_path / "u"))


def test_incremental_vectors_equal_a_rebuild(spark, tmp_path):
    from gleaner.operators import vectors

    rows = [("s", "p", f"t{i}", f"words number {i}", "") for i in range(30)]
    s = spark.createDataFrame(rows, "source string, project string, title string, content string, retrieval_text string")
    path = str(tmp_path / "v")
    empty = spark.createDataFrame([], vector_store.VECTOR_SCHEMA)
    vector_store.append_vectors(vectors.build_vectors(s.limit(10), empty), path)
    stored = vector_store.read_vectors(spark, path)
    second = vectors.build_vectors(s, stored)
    assert second.count() == 20
    vector_store.append_vectors(second, path)
    whole = {r.section_key: r.embedding for r in vectors.build_vectors(s, empty).collect()}
    grown = {r.section_key: r.embedding for r in vector_store.read_vectors(spark, path).collect()}
    assert grown == whole and len(whole) == 30


def test_diagram_labels_keep_their_last_text_without_markup(spark):
    source = 'a["x<br>y &nbsp; z"] --> b[ ]\nb --> c\na[<b> last </b>] --> d[D & E]\nd --> a'
    row = spark.createDataFrame([(source,)], "s string").select(
        markup.diagram_nodes(F.col("s")).alias("n"), markup.diagram_text(F.col("s")).alias("t")
    ).first()
    assert [tuple(n) for n in row.n] == [("a", "last"), ("b", ""), ("d", "D & E")]
    lines = row.t.split("\n")[1:]
    assert lines[:3] == [lx.DIAGRAM_NODE + name for name in ("last", "b", "D & E")]
    assert lx.DIAGRAM_EDGE + "b" + lx.DIAGRAM_ARROW + "c" in lines and lx.DIAGRAM_EDGE + "D & E" + lx.DIAGRAM_ARROW + "last" in lines
