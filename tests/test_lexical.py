"""The postings plan against a brute-force scorer over every pair, and fusion rules."""

import re

from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.operators import features, fusion, lexical

SECTIONS = [
    # doc_ord, title, source, project, content, aliases, role, source_type
    (0, "RAG 知识库怎么设计", "a.md", "甲项目", "检索 retrieval 和 rerank 的设计方案，3 个步骤", ["RAG 怎么做"], "project", None),
    (1, "Agent 是什么", "a.md", "甲项目", "agents coordinate tools；concatenate cats", [], "project", None),
    (2, "评分规则怎么制定", "b.md", "乙平台", "指标 权重 口径；结果提升", ["指标怎么算"], "project-metric", None),
    (3, "自我介绍", "c.md", "", "我的经历 与 优势", [], "profile", None),
    (4, "术语", "AI产品经理术语表.md", "", "RAG Agent", [], "general", None),
    (5, "x", "d.md", "", "the cat sat in the category of rag-based systems", [], "general", None),
    (6, "挑战与难点", "d.md", "rag-lab", "困难 很多 问题 如何 解决", [], "project-retrospective", None),
    (7, "术语", "e.md", "", "RAG", [], "general", "glossary"),
    (8, "项目背景", "e.md", "团队", "原因 团队 离职 架构 效果", [], "project-background", None),
]
QUESTIONS = [
    (0, "RAG 知识库怎么设计？"),
    (1, "rubric 怎么算 cat 的 cat"),
    (2, "介绍你的经历，有什么优势"),
    (3, "区别是什么？"),
    (4, "Agent 是什么 和 RAG agent"),
    (5, "你们的项目背景 困难 问题怎么解决，为什么"),
    (6, "的 是 了"),
    (7, "in ra 有几个步骤"),
    (8, "Multi Agent 是什么 x 自我介绍"),
]


def words(text):
    spaced = re.sub(r"([一-鿿])", r" \1 ", text.lower())
    found = re.sub(r"[^0-9a-z一-鿿]+", " ", spaced).split()
    return [w for w in found if w not in lx.STOP_TOKENS and (len(w) > 1 or "一" <= w <= "鿿")]


def brute_force(query, section):
    doc, title, _, project, content, aliases, role, _ = section
    query = re.sub(r"(?i)(?<![A-Za-z0-9_])rubrics?(?![A-Za-z0-9_])", "评分规则", query)
    fields = [(words(title), 3), (words(" ".join(aliases)), 2), (words(project), 2), (words(content), 1)]
    direct = sum(min(4, sum(w * sum(t in c for c in ws) for ws, w in fields)) for t in words(query))
    phrase = 10 if len(title) > 1 and title in query else 0
    terms = {t for t in re.findall(r"[a-z][a-z0-9_-]+|[一-鿿]{2,}", query.lower()) if t not in lx.TITLE_STOP_TERMS}
    named = (title + " " + " ".join(aliases)).lower()
    covered = sum(t in named for t in terms)
    technical = 0
    for t in set(re.findall(r"[a-z][a-z0-9_-]+", query.lower())):
        technical += 16 if t in title.lower() else 12 if t in project.lower() else 6 if t in content.lower() else 0
    concept = sum(
        4 if name in title else 2 if name in content else 0
        for name, variants in lx.CONCEPTS
        if any(v.lower() in query.lower() for v in variants)
    )
    kind = next((n for n, p in lx.INTENT_RULES if re.search(p.replace("(?iu)", "(?i)"), query)), "general")
    values = {"title": title, "text": f"{title} {content}", "role": role}
    intent = next(
        (pts for n, f, p, pts in lx.INTENT_BONUS if n == kind and re.search(p.replace("(?iu)", "(?i)").replace(r"\z", r"\Z"), values[f])),
        0,
    )
    total = direct + phrase + (covered * 24 if covered >= 2 else 0) + technical + concept + intent
    label = ("hybrid" if concept else "keyword") if direct else "semantic"
    return total, label


def usable(query):
    squeezed = re.sub(r"[\s，,。！？?!]", "", query)
    return words(query) and not re.search(lx.GENERIC_QUERY.replace(r"\z", r"\Z"), squeezed)


def test_postings_plan_equals_brute_force(spark):
    schema = (
        "doc_ord long, title string, source string, project string, content string, aliases array<string>, role string, "
        "source_type string"
    )
    s = spark.createDataFrame(SECTIONS, schema).withColumns({"section_ord": F.lit(0), "chunk_index": F.lit(0)})
    q = features.question_features(spark.createDataFrame(QUESTIONS, "query_id long, query string"))
    got = {
        (r.query_id, r.rank): (r.doc_ord, r.score, r.match_type) for r in lexical.search(q, s, k=5).collect()
    }
    want = {}
    for qid, query in QUESTIONS:
        if not usable(query):
            continue
        scored = [(brute_force(query, x), x[0]) for x in SECTIONS if x[0] not in (4, 7)]
        ranked = sorted(((-p, d, label) for (p, label), d in scored if p > 0))[:5]
        want.update({(qid, i + 1): (d, -p, label) for i, (p, d, label) in enumerate(ranked)})
    assert got == want
    assert {label for _, _, label in got.values()} == {"keyword", "hybrid", "semantic"}


def test_contains_join_is_exact(spark):
    from gleaner.operators.containment import contains_join

    hay = ["", "a", "ab", "abc", "xabcx", "检索增强", "aaa", "b c"]
    needles = ["a", "b", "ab", "abc", "检", "索增", "aa", "abcx", " c", "zz"]
    h = spark.createDataFrame([(x,) for x in hay], "haystack string")
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    want = sorted((x, y) for x in hay for y in needles if y in x)
    for small in ("needles", "haystacks"):
        got = contains_join(h, n, small=small).select("haystack", "needle").collect()
        assert sorted(map(tuple, got)) == want


def test_contains_join_checks_broadcast_needles_in_place(spark):
    """Candidates outnumber the text they come from, so they must not be exchanged before the check."""
    from gleaner.operators.containment import contained_words, contains_join

    h = spark.createDataFrame([("retrieval of knowledge",), ("knower",)], "haystack string")
    n = spark.createDataFrame([("knowl",), ("retrieval",), ("xknow",)], "needle string")
    for joined in (contains_join(h, n, sizes=(5,)), contained_words(h, n, word="haystack", size=5)):
        assert sorted(map(tuple, joined.collect())) == [("retrieval of knowledge", "knowl"), ("retrieval of knowledge", "retrieval")]
        probe = joined._jdf.queryExecution().optimizedPlan().toString()
        assert "_h1" not in probe and probe.count("Join") == 2 + probe.count("LeftSemi")


def test_possible_needles_lose_no_pair(spark):
    from gleaner.operators.containment import possible_needles

    h = spark.createDataFrame([("the leader",), ("agent \n one",), (None,)], "haystack string")
    n = spark.createDataFrame([("leader",), ("he lea",), ("t \n o",), ("a b c",), ("leader of all the agents",)], "needle string")
    assert sorted(r.needle for r in possible_needles(n, h).collect()) == ["he lea", "leader", "t \n o"]
    assert possible_needles(n, h.limit(0)).count() == 0


def test_title_forms_multiply_coverage(spark):
    rows = [(1, "Agent memory", "p"), (2, "AGENT memory", "p"), (3, "Agent memory", "p"), (4, "agent Memory", "q"), (5, None, "p")]
    s = spark.createDataFrame(rows, "doc_ord int, title string, project string").withColumns(
        {"section_ord": F.lit(0), "chunk_index": F.lit(0), "content": F.lit(""), "role": F.lit(""), "aliases": F.array("project")}
    )
    counted = lexical.with_title_forms(s, s)
    assert {r.doc_ord: r.title_forms for r in counted.collect()} == {1: 2, 2: 2, 3: 2, 4: 1, 5: 1}
    postings = spark.createDataFrame([(1, "agent", 0, 0, 1, 0)], "query_id int, needle string, nt int, nx int, nc int, nr int")
    scored = {r.doc_ord: r.coverage for r in lexical.score_pairs(counted, postings).collect()}
    assert scored == {1: 48, 2: 48, 3: 48}
    assert lexical.score_pairs(s, postings).count() == 0


def test_words_that_cancel_out_have_a_vector():
    from itertools import count
    from zlib import crc32

    from gleaner.operators.vectors import hashed_embedder

    first = crc32(b"agent")
    other = next(f"w{i}" for i in count() if crc32(f"w{i}".encode()) % 64 == first % 64 and (crc32(f"w{i}".encode()) ^ first) >> 31)
    both, none = hashed_embedder()([f"agent {other}", " "])
    assert abs(float(both @ both) - 1) < 1e-6 and not none.any()


def test_tiled_similarities_equal_row_by_row_cosines(spark, monkeypatch):
    from gleaner.functions import similarity
    from gleaner.operators import vectors

    monkeypatch.setattr(vectors, "QUERY_TILE", 3)
    monkeypatch.setattr(vectors, "STORED_TILE", 8)
    odd = [None, [], [0.0, 0.0], [1.0, None], [1.0], [float("nan"), 1.0], [float("inf"), 1.0]]
    values = odd + [[float(i % 5) - 2, float(i % 3) - 0.7] for i in range(40)]
    v = spark.createDataFrame(list(enumerate(values)), "vec_id long, embedding array<float>").repartition(3)
    q = v.filter("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    plain = q.join(v, F.col("query_id") != F.col("vec_id")).select(
        "query_id", "vec_id", similarity.cosine("query_vector", "embedding").alias("semantic_score")
    )

    def rows(df):
        return sorted(map(str, df.select("query_id", "vec_id", "semantic_score").collect()))

    assert rows(vectors.similarities(q, v, ["vec_id"], "vec_id")) == rows(plain)
    bounded = vectors.similarities(q, v, ["vec_id"], "vec_id", at_least=0.2)
    assert rows(vectors.threshold_rank(bounded, ["vec_id"], 0.2)) == rows(plain.filter("semantic_score >= 0.2"))
    best = vectors.similarities(q, v, ["vec_id"], "vec_id", best=2)
    assert best.count() < plain.count()
    assert rows(vectors.vector_top_k(best, ["vec_id"], 2)) == rows(vectors.vector_top_k(plain, ["vec_id"], 2))


RANKED = "query_id long, rank int, score double, match_type string, source string, project string, title string, content string"


def test_fusion(spark):
    q = spark.createDataFrame(
        [(1, "leader agent"), (2, "named zeta"), (3, "nothing lexical"), (4, "dup")], "query_id long, query string"
    )
    lex = spark.createDataFrame(
        [
            (1, 1, 9.0, "keyword", "s", "P", "first", "c1"),
            (1, 2, 8.0, "keyword", "s", "P", "The Leader Agent", "c2"),
            (2, 1, 5.0, "keyword", "s", "P", "t", "c"),
            (4, 1, 5.0, "keyword", "s", "P", "t", "c"),
            (4, 2, 5.0, "keyword", "s", "P", "t", "c"),
            (4, 3, 4.0, "keyword", "s", "P", "u", "c"),
        ],
        RANKED,
    )
    sem = spark.createDataFrame(
        [
            (1, 1, 9.0, "semantic", "s", "Q", "out of scope", "c9", 0.9),
            (1, 2, 8.0, "semantic", "s", " p ", "first", "c1", 0.8),
            (1, 3, 8.0, "semantic", "s", "P", "only semantic", "c3", 0.7),
            (2, 1, 8.0, "semantic", "s", "Zeta", "by name", "c", 0.8),
            (2, 2, 8.0, "semantic", "s", "", "no project", "c", 0.8),
            (3, 1, 8.0, "semantic", "s", "", "free", "c", 0.5),
        ],
        RANKED + ", semantic_score double",
    )
    got = {}
    for r in fusion.fuse(lex, sem, q).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.title, r.match_type, round(r.ranking_score, 6)))
    # "first" differs in project spelling, so it is not the same candidate as the semantic row
    assert got[1] == [
        ("The Leader Agent", "keyword", round(1 / 62 + 0.26, 6)),
        ("first", "keyword", round(1 / 61, 6)),
        ("first", "semantic", round(1 / 61, 6)),
        ("only semantic", "semantic", round(1 / 62, 6)),
    ]
    assert got[2] == [("t", "keyword", round(1 / 61, 6)), ("by name", "semantic", round(1 / 61, 6))]
    assert got[3] == [("free", "semantic", round(1 / 61, 6))]
    assert got[4] == [("u", "keyword", round(1 / 63, 6)), ("t", "keyword", round(1 / 62, 6))][::-1]


def test_fusion_marks_hybrid_and_degrades(spark):
    q = spark.createDataFrame([(1, "x")], "query_id long, query string")
    lex = spark.createDataFrame([(1, 1, 9.0, "keyword", "s", "P", "a", "c"), (1, 2, 8.0, "semantic", "s", "P", "b", "c")], RANKED)
    sem = spark.createDataFrame([(1, 1, 3.0, "semantic", "s", "P", "b", "c", 0.9)], RANKED + ", semantic_score double")
    both = fusion.fuse(lex, sem, q).orderBy("rank").collect()
    assert [(r.title, r.match_type, r.semantic_score, r.score) for r in both] == [
        ("b", "hybrid", 0.9, 8.0),
        ("a", "keyword", None, 9.0),
    ]
    alone = fusion.retrieve(lex, None, q).orderBy("rank").collect()
    assert [r.title for r in alone] == ["a", "b"] and not alone[0].semantic_available


def test_cosine_guards(spark):
    from gleaner.functions.similarity import cosine

    rows = [
        ([], []),
        ([1.0], [1.0, 2.0]),
        ([0.0, 0.0], [1.0, 1.0]),
        ([1.0, 2.0], [-1.0, -2.0]),
        ([3.0, 4.0], [3.0, 4.0]),
        (None, [1.0]),
    ]
    d = spark.createDataFrame(rows, "a array<float>, b array<float>")
    assert [round(r.c, 6) for r in d.select(cosine("a", "b").alias("c")).collect()] == [0, 0, 0, -1, 1, 0]


def test_pairs_in_place_equal_the_joins(spark, monkeypatch):
    """Sections repeated under one key, over several batches and blocks; needles in parts of words, alone and as rules."""
    words = ["agent", "agents", "memory", "re", "a", "项目", "memo-ry", "Éen", "x" * 300]
    rows = [
        (i % 40 if i % 40 != 7 else None, 0, i % 3, " ".join(words[i % 4 : i % 4 + 2]), " ".join(words[(i * j) % 9] for j in range(i % 7)),
         words[i % 5], "profile" if i % 6 else None, ["ment", None] if i % 2 else None)
        for i in range(300)
    ]
    s = spark.createDataFrame(
        rows, "doc_ord int, section_ord int, chunk_index int, title string, content string, project string, role string, aliases array<string>"
    )
    needles = [(q, n, 1 + q % 2, int(n != "re"), q % 2, 0) for q in range(30) for n in ("gent", "re", "mem", "x" * 200, "a", "项目", None)]
    needles += [(q, f"{lexical._RULE}{r}", 0, 0, 0, 1) for q in (1, 2, None) for r in ("kment", "pagent agents", "imetric")]
    p = spark.createDataFrame(needles, "query_id long, needle string, nt int, nx int, nc int, nr int")
    rules = {"groups": (("ment", ("ment",)),), "bonus": (("metric", "title", "agent", 60),)}
    monkeypatch.setattr(lexical, "CELLS", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = lexical.score_pairs(s, p, **rules)
        assert "MapInArrow" in got._jdf.queryExecution().toString()
        mine = sorted(map(str, got.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(lexical, "fits_broadcast", lambda df: False)
    joined = lexical.score_pairs(s, p, **rules).select(*got.columns)
    assert mine == sorted(map(str, joined.collect())) and len(mine) > 1000
    assert lexical.score_pairs(s.limit(0), p).count() == 0


def _repeated_sections(spark):
    words = ["agent", "agents", "memory", "re", "rerere", "memo-ry", "Éen", "项目", "agentagent"]
    rows = [
        (i, 0, i % 3, " ".join(words[i % 4 : i % 4 + 2]), " ".join(words[(i * j) % 9] for j in range(i % 7)), words[i % 5], "profile", ["ment"])
        for i in range(400)
    ]
    schema = "doc_ord int, section_ord int, chunk_index int, title string, content string, project string, role string, aliases array<string>"
    needles = [(q, n, 1 + q % 2, int(n != "re"), q % 2, 0) for q in range(5) for n in ("gent", "re", "mem", "en")]
    needles += [(q, f"{lexical._RULE}{r}", 0, 0, 0, 1) for q in (1, 2) for r in ("kagent", "pagent agents", "imetric")]
    p = spark.createDataFrame(needles, "query_id long, needle string, nt int, nx int, nc int, nr int")
    rules = {"groups": (("ment", ("ment",)), ("agent", ("agent",))), "bonus": (("metric", "title", "agent", 60),)}
    return spark.createDataFrame(rows, schema), p, rules


def test_only_pairs_that_may_be_best_leave_a_task(spark, monkeypatch):
    """Many ties, blocks of twelve sections: the top rows are those of all pairs, and few others come along."""
    s, p, rules = _repeated_sections(spark)
    monkeypatch.setattr(lexical, "CELLS", 64)
    every = lexical.score_pairs(s, p, **rules)
    limits = [("score", 4), ("technical", 2)]
    best = lexical.score_pairs(s, p, **rules, best=limits)
    for score, k in limits:
        want, got = (sorted(map(str, lexical.top_k(d, k, score=score).select(*every.columns, "rank").collect())) for d in (every, best))
        assert got == want and len(got) == 5 * k
    assert best.count() < every.count() / 3


def test_parts_are_scored_alone(spark, monkeypatch):
    s, p, rules = _repeated_sections(spark)
    every = [r.asDict() for r in lexical.score_pairs(s, p, **rules).collect()]
    key = ("query_id", "doc_ord", "chunk_index")
    for joined in (False, True):
        if joined:
            monkeypatch.setattr(lexical, "fits_broadcast", lambda df: False)
        for part in lexical.COMPONENTS if not joined else ("technical",):
            alone = lexical.score_pairs(s, p, **rules, parts=(part,)).collect()
            want = {(*(r[k] for k in key), r[part]) for r in every if r[part]}
            assert {(*(r[k] for k in key), r["score"]) for r in alone} == want and want
            assert all(r[c] == 0 for r in alone for c in lexical.COMPONENTS if c != part)


def test_needles_are_found_in_words_by_bytes(monkeypatch):
    import random

    import pyarrow as pa

    from gleaner.operators import needle_sums

    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abé项") for _ in range(rng.randint(1, 5))) for _ in range(120)}) + [f"{needle_sums.RULE}pab", ""]
    words = list({"".join(rng.choice("abé项") for _ in range(rng.randint(0, 12))) for _ in range(300)}) + [f"{needle_sums.RULE}pab"]
    flags = {f: [1] * len(names) for f in ("nt", "nx", "nc", "nr")}
    postings = pa.table({"query_id": list(range(len(names))), "needle": names} | flags)
    for table in (needle_sums.TABLE, 0):
        monkeypatch.setattr(needle_sums, "TABLE", table)
        ends, found = needle_sums.Needles.of(postings).inside(pa.array(words[1:], pa.large_string()).slice(1))
        for i, word in enumerate(words[2:]):
            rule = word.startswith(needle_sums.RULE)
            want = {j for j, n in enumerate(names) if (n == word if rule or len(word) < 2 or len(n) < 2 else n in word)}
            mine = found[ends[i] : ends[i + 1]].tolist()
            assert sorted(mine) == sorted(want), word


def test_only_documents_with_a_quoted_title_are_cut(spark, monkeypatch):
    """Title phrases alone: the pairs are those of all documents, but few documents are cut, and no title form is sought."""
    from gleaner.plans import base
    from gleaner.plans import lexical as plans

    texts = ["Agents meet again. " * 9, "agents meet in lower case", "Memory of all things", "Memory  of two blanks", "of", ""] * 5
    docs = [(i, t, "src1", "de" if i % 2 else "en") for i, t in enumerate([*texts, None, "Quoted twice\n\nQuoted twice again"])]
    asked = [("a", "where Agents meet Memory of old agents"), ("b", "Quoted twice, Quoted twice"), ("c", "nothing of that kind")]
    tables = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"),
        "benchmark": spark.createDataFrame(asked, "item_id string, text string"),
    }
    for module in (base, plans):
        monkeypatch.setattr(module, "table", lambda spark, sf_dir, name: tables[name])
    key = ("query_id", "doc_ord", "chunk_index", "phrase")
    want = {tuple(r[k] for k in key) for r in plans.pairs(spark, "").filter("phrase > 0").collect()}
    cut, whole = [], base.partitioned_chunks
    monkeypatch.setattr(base, "partitioned_chunks", lambda spark, d: cut.append({r.title for r in d.collect()}) or whole(spark, d))
    monkeypatch.setattr(lexical, "with_title_forms", None)
    assert {tuple(r[k] for k in key) for r in plans.pairs(spark, "", parts=("phrase",)).collect()} == want and len(want) == 21
    assert cut == [{"Agents meet", "Memory of", "Quoted twice", "of"}]
    plans.pairs(spark, "", parts=("intent",))
    nobody = spark.createDataFrame([], "query_id string")
    assert plans.pairs(spark, "", asked=nobody).count() == 0 and cut[-1] == set()


def test_subject_pairs_are_written_from_their_join(spark, tmp_path, monkeypatch):
    """Each pair once, with repeated and missing keys and a frequent phrase; what is shuffled are rows, not pairs."""
    import re

    from gleaner.operators import containment
    from gleaner.plans import retrieval

    monkeypatch.setattr(containment, "TILE", 3)
    docs = [(i % 40, f"The Plan number {i}") for i in range(60)] + [(3, "Our plan b"), (None, "the plan"), (None, "a the plane"), (7, None), (8, "solo")]
    docs += [(100 + i, f"{w} plan-b is") for i, w in enumerate(["other", "an other", "another"])]
    turns = [(i % 9, i, "the plan, or É another plan-b") for i in range(20)] + [(1, 2, "the plan"), (None, None, "her plan É he plan"), (5, 5, None)]
    turns += [(6, 6, "r plan-b É the plan")] * 2 + [(6, 7, "plan")]
    spark.createDataFrame([(d, t, "en", "src1", 0) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(c, t, "user", x) for c, t, x in turns], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    made = retrieval.exact_subject_boost(spark, str(tmp_path))
    phrase, want = re.compile(r"[a-z][a-z0-9_-]*(?:\s+[a-z][a-z0-9_-]*)+"), set()
    for doc, text in docs:
        title = re.match(r"\s*(\S+(?:\s+\S+)?)", text or "")
        for conv, turn, said in turns:
            if title and any(p in title[1].lower() for p in phrase.findall((said or "").lower())):
                want.add((conv, turn, doc))
    assert any(w[0] is None for w in want) and any(w[2] is None for w in want) and len(want) > 500
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(want, key=repr)
    above = made._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0]
    assert "Exchange" not in above and "Aggregate" not in above
