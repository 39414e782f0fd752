"""Glossary, turns, project context, eligibility and routing on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.operators import glossary, ordered, policy, routing, turns


def column(spark, expr, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.o for r in rows.select("i", expr.alias("o")).orderBy("i").collect()]


def test_dictionary_is_longest_first_and_never_rewrites(spark):
    entries = [
        ("RAGC", ["AIG"]),
        ("GitHub Copilot", ["git hub copilot"]),
        ("GitHub", ["git hub", "GitHub Copilot x"]),
        ("Rerank", ["重排"]),
        ("A.B", ["a.b"]),
        ("X1", ["cd e"]),
        ("X2", ["b cd"]),
        ("First", ["same"]),
        ("Second", ["same"]),
        ("N", ["12"]),
    ]
    texts = ["AIGC 和 AIG", "git hub copilot 与 git hub", "用重排做", "xa.by", "b cd e", "same", "12 a 12", None]
    got = column(spark, glossary.normalise_terms("t", entries), texts)
    assert got == ["AIGC 和 RAGC", "GitHub Copilot 与 GitHub", "用Rerank做", "xA.By", "b X1", "First", "N a N", None]


def test_context_rules(spark):
    texts = [
        "最优 项目的口径",
        "最优的方案",
        "deepfake 有了解吗 seek Honeys 怎么样",
        "scale 是什么",
        "scale 是什么 用户规模化",
        "什么是 lope",
        "什么是 lope 模型",
        "PM25 怎么用",
        "今天 PM2.5 高",
        "克劳德 扣德 好用",
    ]
    want = [
        "GEO 项目的口径",
        "最优的方案",
        "DeepSeek Harness 怎么样",
        "Skill 是什么",
        "scale 是什么 用户规模化",
        "什么是 Loop",
        "什么是 lope 模型",
        "BM25 怎么用",
        "今天 PM2.5 高",
        "Claude Code 好用",
    ]
    assert column(spark, glossary.apply_context_rules("t"), texts) == want


def test_turns(spark):
    texts = ["为什么？", "介绍一下项目", "我想问一下", "好的", "刚才说到的方案", "这个项目的指标怎么"]
    got = column(spark, turns.classify_turn("t"), texts)
    assert [(g.complete, g.follow_up, g.delay_ms) for g in got] == [
        (True, True, 1200),
        (True, False, 1200),
        (False, False, 2200),
        (False, False, 2200),
        (True, True, 1200),
        (False, True, 2200),
    ]
    assert column(spark, turns.is_confirmed("t"), ["为什么?", "好的", "四个字呀", ""]) == [True, False, True, False]
    questions = ["先聊聊。如果从零到一做项目。你会怎么做？", "你好说说项目然后你的优势是什么", "请自我介绍一下", "其他。区别是什么", "，。"]
    assert column(spark, turns.latest_question("t"), questions) == [
        "如果从零到一做项目。你会怎么做",
        "你的优势是什么",
        "请自我介绍一下",
        "其他。区别是什么",
        "",
    ]
    assert column(spark, turns.collapse_repeats("t"), ["请介绍请介绍 一下 a 项目", "你觉得你觉得 AI  好"]) == [
        "请介绍 一下  项目".replace("  ", " "),
        "你觉得 AI 好",
    ]


def test_ordered_operators_match_plain_windows_across_blocks(spark):
    rows = [(k, i, None if (i * 7 + k) % 3 else i * 10 + k) for k in range(3) for i in range(0, 60, 1 + k)]
    d = spark.createDataFrame(rows, "k int, i int, v int")
    w = ordered.Window.partitionBy("k").orderBy("i")
    block = F.floor(F.col("i") / 4)
    got = ordered.carry_forward(d, ["k"], "i", F.col("v"), "c", block)
    got = ordered.previous_rows(got, ["k"], "i", F.col("i"), 3, "p", block)
    got = ordered.running_max(got, ["k"], "i", "v", "m", block)
    want = d.select(
        "k",
        "i",
        "v",
        F.last("v", True).over(w.rowsBetween(ordered.Window.unboundedPreceding, -1)).alias("c"),
        F.collect_list("i").over(w.rowsBetween(-3, -1)).alias("p"),
        F.max("v").over(w.rowsBetween(ordered.Window.unboundedPreceding, 0)).alias("m"),
    )
    assert sorted(map(str, got.select("k", "i", "v", "c", "p", "m").collect())) == sorted(map(str, want.collect()))


def test_project_context(spark):
    projects = spark.createDataFrame(
        [("geo", "GEO", 1, ["极欧"]), ("geo plus", "GEO Plus", 2, []), ("乙", "乙", 3, [])], "id string, name string, ord int, aliases array<string>"
    )
    q = spark.createDataFrame(
        [(1, "geo plus 怎么样"), (2, "极欧的指标"), (3, "没有项目"), (4, "乙和GEO")], "query_id int, query string"
    )
    got = {r.query_id: r.explicit_id for r in policy.explicit_projects(q, projects).collect()}
    assert got == {1: "geo plus", 2: "geo", 4: "geo"}
    long = q.union(spark.createDataFrame([(5, "ageo plusb"), (6, "Xgeo"), (7, "plus geo"), (8, None), (1, "geo")], q.schema))
    for sizes in ((1, 2, 3), (1, 2, 3, 4)):
        got = sorted((r.query_id, r.explicit_id) for r in policy.explicit_projects(long, projects, sizes=sizes).collect())
        assert got == [(1, "geo plus"), (2, "geo"), (4, "geo"), (5, "geo plus"), (6, "geo"), (7, "geo")]
    rows = spark.createDataFrame(
        [("x", "a", "b", "l"), ("x", "a", "b", None), ("CEO 项目", None, "b", None), ("x", None, "b", None), ("x", None, None, None)],
        "t string, e string, a string, l string",
    )
    resolved = rows.select(policy.resolve_context("t", "e", "a", "l").alias("r")).collect()
    assert [(r.r.project_id, r.r.source, r.r.confidence) for r in resolved] == [
        ("l", "locked", 1.0),
        ("a", "explicit", 1.0),
        ("", "unknown", 0.0),
        ("b", "context", 0.7),
        ("", "unknown", 0.0),
    ]


SECTION = (
    "doc_ord int, section_ord int, chunk_index int, title string, source string, project string, content string, archive boolean, "
    "source_type string"
)


def materials(spark, rows, questions):
    s = spark.createDataFrame([(i, 0, 0, *r) for i, r in enumerate(rows)], SECTION)
    flags = policy.section_flags(s)
    q = spark.createDataFrame(questions, "query_id int, query string, scope string")
    kept = policy.select_materials(q.crossJoin(flags), flags)
    out = {row[0]: [] for row in questions}
    for r in kept.orderBy("query_id", "doc_ord").collect():
        out[r.query_id].append(r.doc_ord)
    return out


def test_eligibility(spark):
    rows = [
        ("自我介绍", "p.md", "", "x", False, None),  # 0 profile
        ("RAG 怎么设计", "a.md", "甲", "current", False, None),  # 1 current
        ("Agent 架构是什么", "a.md", "甲", "old", True, None),  # 2 archived, another question
        ("RAG 怎么设计", "a.md", "甲", "old", True, None),  # 3 archived twin of 1
        ("旧项目", "b.md", "乙", "only old", True, None),  # 4 archived, no current row in its source
        ("术语", "AI产品经理术语表.md", "", "x", False, None),  # 5 glossary
        ("技能", "s.md", "", "x", False, "skill"),  # 6 skill
        ("我写代码", "c.md", "", "我用 Cursor 编程", False, None),  # 7 practice evidence
        ("最近关注的 AI 趋势", "t.md", "", "x", False, None),  # 8 trend
    ]
    got = materials(
        spark,
        rows,
        [
            (1, "无关问题", "general"),
            (2, "无关问题", "experience"),
            (3, "无关问题", "product"),
            (4, "Agent 怎么用", "project"),
            (5, "我自己的 Coding 项目", "experience"),
            (6, "最近关注哪些 AI 模型", "general"),
            (7, "Agent 架构是什么", "general"),
            (8, "RAG 怎么设计", "general"),
        ],
    )
    assert got == {
        1: [1, 4, 7, 8],
        2: [0, 1, 4, 7, 8],
        3: [],
        4: [1, 2, 3, 4, 7, 8],
        5: [0, 7],
        6: [8],
        7: [2],
        8: [1, 4, 7, 8],
    }
    with_method = [*rows, ("方法", "面试知识库-通用面试问题.md", "", "x", False, None)]
    got = materials(spark, with_method, [(1, "无关问题", "general"), (7, "Agent 架构是什么", "general")])
    assert got == {1: [9], 7: [2, 9]}


def test_personal_context(spark):
    s = spark.createDataFrame([(0, 0, 0, "x", "s", "", "y", False, None), (1, 0, 0, "自我介绍", "s", "", "z" * 9000, False, None)], SECTION)
    context = policy.personal_context(s)
    q = spark.createDataFrame([(1, "project"), (2, "general")], "query_id int, scope string")
    got = {r.query_id: r.personal_context for r in policy.add_personal_context(q, context).collect()}
    assert got[2] == "" and len(got[1]) == 9007 and got[1].startswith("【自我介绍】\nzz")


CANDIDATE = (
    "query_id int, rank int, doc_ord int, section_ord int, chunk_index int, source string, project string, title string, content string, "
    "score double, match_type string, semantic_score double"
)


def candidate(query_id, rank, doc, title, content, score, project="", kind="keyword", similarity=None):
    return (query_id, rank, doc, 0, 0, "s", project, title, content, float(score), kind, similarity)


def test_every_routing_outcome(spark):
    cases = [
        # query, allow_overview, candidates (title, content, score), expected mode, confidence, documents
        ("介绍一下你的项目", False, [("自我介绍", "x", 5)], ("direct", 94.0, [0])),  # 1
        ("说说你的项目。", False, [("别的", "x", 5)], ("fallback", 0.0, [])),  # 1 without a profile
        ("请介绍一下", False, [("别的", "x", 9), ("个人经历", "x", 5)], ("direct", 94.0, [1])),  # 2
        ("如果让你设计一个产品怎么做", False, [("产品", "x", 9)], ("fallback", 0.0, [])),  # 3
        ("假如给你一个场景怎么设计", True, [("产品", "x", 9)], ("compose", 90.0, [100])),  # 4
        ("无", False, [("当前飞书版本", "x", 9)], ("fallback", 0.0, [])),  # 5
        ("我做过的 Coding", False, [("a", "用 Cursor", 9), ("b", "y", 8)], ("compose", 88.0, [0])),  # 6
        ("我做过的 Coding", False, [("b", "y", 8)], ("fallback", 0.0, [])),  # 6 without material
        ("系统用了哪些技术栈", False, [("b", "y", 8)], ("compose", 88.0, [200])),  # 7
        ("Agent 是什么", False, [("工具", "agent", 9), ("Agent 是什么", "y", 8)], ("direct", 98.0, [1])),  # 8
        ("这个项目怎么做", True, [("b", "y", 8)], ("compose", 80.0, [100])),  # 9
        ("RAG 召回", False, [("b", "y", 8)], ("fallback", 0.0, [])),  # 10
        ("召回策略", False, [("b", "召回策略", 9)], ("direct", 88.0, [0])),  # 11
        ("有几个召回策略", False, [("b", "召回策略 3 个", 2)], ("direct", 74.0, [0])),  # 11 count
        ("召回策略", False, [("b", "召回策略", 3), ("c", "召回策略", 2)], ("compose", 56.0, [0, 1])),  # 12
        ("召回策略", False, [("b", "召回策略", 3), ("c", "无", 2)], ("supplement", 41.0, [0])),  # 13
    ]
    q = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "query_id int, query string, allow_overview boolean")
    rows = [candidate(i, r + 1, r, *m) for i, c in enumerate(cases) for r, m in enumerate(c[2])]
    c = spark.createDataFrame(rows, CANDIDATE)
    picks = [(i, j) for i in range(len(cases)) for j in (100, 200)]
    overview = spark.createDataFrame([candidate(i, 1, 100, "项目简介", "x", 20) for i, j in picks if j == 100], CANDIDATE)
    technology = spark.createDataFrame([candidate(i, 1, 200, "技术架构", "x", 18) for i, j in picks if j == 200], CANDIDATE)
    got = {r.query_id: r for r in routing.route(q, c, overview, technology).collect()}
    for i, case in enumerate(cases):
        r = got[i]
        assert (r.mode, r.confidence, [m.doc_ord for m in r.matches]) == case[3], case[0]
    evidence = {r.query_id: r.mode for r in routing.select_evidence(routing.route(q, c, overview, technology)).collect()}
    assert evidence[12] == "grounded" and evidence[15] == "llm-only"


def test_semantic_matches_need_a_high_cosine(spark):
    q = spark.createDataFrame([(1, "召回策略", False), (2, "召回策略", False)], "query_id int, query string, allow_overview boolean")
    c = spark.createDataFrame(
        [
            candidate(1, 1, 0, "b", "召回策略", 9, kind="semantic", similarity=0.82),
            candidate(2, 1, 0, "b", "召回策略", 9, kind="semantic"),
        ],
        CANDIDATE,
    )
    got = {r.query_id: r.mode for r in routing.select_evidence(routing.route(q, c)).collect()}
    assert got == {1: "grounded", 2: "llm-only"}


def test_specific_evidence(spark):
    text = F.col("t")
    check = lambda query: routing.specific_evidence(F.lit(query), text)
    assert column(spark, check("召回和重排有什么区别"), ["讲召回率", "讲评测"]) == [True, False]
    assert column(spark, check("重新做一个项目会怎样"), ["复盘 会怎样", "会怎样"]) == [True, False]
    assert column(spark, check("你做过项目吗"), ["我负责过这个平台", "别的"]) == [True, False]
    assert column(spark, check("RAG 与 agent"), ["rag agent", "rag"]) == [True, False]


def test_picks_take_one_per_title(spark):
    rows = [
        (1, 0, 0, 0, "项目背景", "x", None),
        (1, 1, 0, 0, "项目简介", "x", 30),
        (1, 2, 0, 0, "项目简介", "x", 40),
        (1, 3, 0, 0, "完整原文资料 项目简介", "x", 40),
        (1, 4, 0, 0, "核心能力", "x", 1),
    ]
    m = spark.createDataFrame(rows, "query_id int, doc_ord int, section_ord int, chunk_index int, title string, content string, score int")
    got = routing.priority_pick(m, lx.OVERVIEW_PRIORITY, lx.OVERVIEW_TAKE, lx.OVERVIEW_FLOOR).orderBy("rank").collect()
    assert [(r.doc_ord, r.score) for r in got] == [(1, 30), (0, 20)]


@pytest.mark.parametrize("limit", [2, 6])
def test_siblings_can_push_out_a_later_match(spark, limit):
    rows = [(d, 0, c, "s", "p", f"t{d}") for d in range(2) for c in range(3)]
    s = spark.createDataFrame(rows, "doc_ord int, section_ord int, chunk_index int, source string, project string, title string")
    m = s.filter("(doc_ord = 0 and chunk_index = 1) or (doc_ord = 1 and chunk_index = 2)").withColumns(
        {"query_id": F.lit(1), "rank": F.col("doc_ord") + 1}
    )
    got = routing.expand_siblings(m, s, limit=limit).orderBy("rank").collect()
    assert [(r.doc_ord, r.chunk_index) for r in got] == [(0, 1), (0, 0), (0, 2), (1, 2), (1, 0), (1, 1)][:limit]


def test_title_routes_leave_texts_behind(spark, monkeypatch, tmp_path):
    """The routes are those of whole candidates, and no section's text goes along with a question."""
    from gleaner.plans import title_routing

    lines = ["The memory agent needs ever more ", "Der index braucht ", "La agent tion ", "To the vector store tionth "]
    docs = [(i, (lines[i % 4] + f"word{i % 5} ") * (5 + i % 3), "de" if i % 2 else "en", f"src{i % 3}", 0) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    given, decide = [], title_routing.decide
    monkeypatch.setattr(title_routing, "decide", lambda q, c, *a, **k: given.append(c) or decide(q, c, *a, **k))
    columns = ["query_id", "mode", "confidence", "reason", title_routing._keys("matches").alias("docs")]
    got = sorted(map(tuple, title_routing.title_routes(spark, str(tmp_path)).select(*columns).collect()))
    q = title_routing.title_questions(spark, str(tmp_path))
    whole = decide(q, title_routing.title_candidates(spark, str(tmp_path), q))
    assert got == sorted(map(tuple, whole.select(*columns).collect())) and any(row[4] for row in got)
    assert given[0].count() and not given[0].where("content IS NOT NULL").count()


def test_stated_questions_lose_none(spark):
    """Against every pair of question and title: case, letters that fold to ASCII, terms with hyphens, Han phrases."""
    questions = ["The AGENT", "agent the agent-memory", "agent-memory", "\u017ftate of \u212aey", "State of key", "in", "", None, "7 x",
                 "项目背景怎么样", "项目背景 the agent", "agents", "the the THE", "key \u0130n", "rubric"]
    titles = ["the Agent", "agent the", "Agent-Memory the", "the state of Key", "\u212aey OF \u017fTATE", "thing", "in the", "", None,
              "关于项目背景怎么样", "the 项目背景", "theagents", "IN de key", "\u0130n the key", "评分规则 the"]
    q = spark.createDataFrame(list(enumerate(questions)), "query_id long, query string")
    t = spark.createDataFrame([(x,) for x in titles * 2], "title string")
    for rule in ("(?i)th|de", "的|是"):
        hit = routing.explicit_title("query", "title", rule)
        want = {r.query_id for r in q.crossJoin(t).filter(hit).collect()}
        assert sorted(r.query_id for r in routing.stated_questions(q, t, rule).collect()) == sorted(want)
        assert len(want) >= (8 if rule.startswith("(") else 2)
