"""Documents to routed answers through the public operators, as the README shows."""

from pyspark.sql import functions as F

from gleaner.operators import annotate, features, fusion, lexical, policy, routing, sectioning, turns
from gleaner.session import materialise

KEY = ("doc_ord", "section_ord", "item_ord", "chunk_index")
DOCS = [
    (1, "甲平台.md", "# 甲平台\n## RAG 知识库怎么设计\n切片、混合召回 和 Rerank，召回率提升\n## 召回策略\n向量检索 与 关键词\n", "knowledge"),
    (2, "我.md", "# 自我介绍\n您好，我是 产品经理，有 优势\n", "knowledge"),
    (3, "skill.md", "# RAG 知识库怎么设计\n只是表达\n", "skill"),
]
QUESTIONS = [(1, "RAG 知识库怎么设计？"), (2, "请自我介绍一下"), (3, "微信朋友圈的点赞按钮为什么这样设计"), (4, "区别是什么")]


def test_documents_to_routes(spark):
    documents = spark.createDataFrame(DOCS, "doc_ord int, name string, markdown string, type string")
    chunks = annotate.annotate(sectioning.parse_sections(documents)).withColumn("source_type", F.col("type"))
    chunks = materialise(chunks)
    questions = spark.createDataFrame(QUESTIONS, "query_id int, query string").withColumn(
        "scope",
        policy.answer_scope(
            policy.is_experience("query"), policy.is_external_product("query"), turns.is_follow_up("query"), F.lit("")
        ),
    )
    scopes = {r.query_id: r.scope for r in questions.collect()}
    assert scopes == {1: "general", 2: "experience", 3: "product", 4: "general"}
    q = features.question_features(questions)
    postings = materialise(lexical.question_postings(q, chunks))
    flags = policy.section_flags(chunks, key=KEY)
    pairs = lexical.score_pairs(chunks, postings, KEY).join(flags, list(KEY)).join(
        questions.select("query_id", "query", "scope"), "query_id"
    )
    materials = policy.select_materials(pairs, flags, KEY)
    ranked = lexical.top_k(materials, 12, KEY)
    fused = fusion.retrieve(ranked, None, questions, 12)
    ordered = fused.join(ranked.select("query_id", *fusion.IDENTITY, *KEY), ["query_id", *fusion.IDENTITY])
    routes = routing.route(questions.withColumn("allow_overview", F.lit(False)), ordered)
    got = {r.query_id: (r.mode, [m.title for m in r.matches]) for r in routes.collect()}
    assert got[1] == ("direct", ["RAG 知识库怎么设计"])
    assert got[2] == ("direct", ["自我介绍"])
    assert got[3] == ("fallback", []) and got[4] == ("fallback", [])
    context = {r.query_id: r.context for r in routing.assemble_context(ordered).collect()}
    assert context[1].startswith("【甲平台 / RAG 知识库怎么设计】\n切片")
