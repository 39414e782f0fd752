"""The stored index gives what the full scan gives, whatever the blocks and the passes."""

import random

import pytest

from gleaner.operators import features, lexical, lexical_index

KEY = ("doc_ord", "section_ord", "chunk_index")
WORDS = "retrieval index agent ranking vector store plan metric profile challenge chunk merge stream window".split()


def some_sections(spark, n=300, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        own = rng.sample(WORDS, 4)  # projects speak of different things, so blocks differ
        title = " ".join(rng.sample(WORDS, 2)) if rng.random() < 0.8 else None
        content = " ".join(rng.choice(own) + rng.choice(["", "s", "_x", "1"]) for _ in range(rng.randint(0, 30)))
        rows.append((i // 3, 0, i % 3, title, content, rng.choice(["red", "blue", None]), ["alias", own[0]], "general", "a.md", "knowledge"))
    rows += [(1000 + i, 0, 0, "Copy", "vector store plan", "red", None, None, "a.md", "knowledge") for i in range(20)]  # ties
    schema = "doc_ord long, section_ord int, chunk_index int, title string, content string, project string, aliases array<string>, role string, source string, source_type string"
    return spark.createDataFrame(rows, schema)


def some_questions(spark):
    rows = [(1, "the vector store plan"), (2, "how does retrieval ranking merge"), (3, "window stream challenge"), (4, "zzz nothing")]
    rows += [(5, "Copy"), (6, "agent index of the chunk metric profile")]
    return features.question_features(spark.createDataFrame(rows, "query_id long, query string"))


@pytest.mark.parametrize("questions_a_pass", [lexical_index.QUESTIONS, 3])
def test_equals_full_scan(spark, tmp_path, monkeypatch, questions_a_pass):
    monkeypatch.setattr(lexical_index, "QUESTIONS", questions_a_pass)
    monkeypatch.setattr(lexical_index, "FIRST", 2)
    sections = some_sections(spark)
    index = lexical_index.write(sections, str(tmp_path / "index"), KEY)
    index = lexical_index.read(spark, str(tmp_path / "index"), KEY)  # what another job would read
    questions = some_questions(spark)
    postings = lexical.question_postings(questions, lexical_index.titles(index))
    got = lexical_index.search(index, postings, 4)
    columns = ["query_id", "rank", *KEY, "score", *lexical.COMPONENTS, "match_type"]
    want = lexical.search(questions, sections, 4, KEY).select(*columns)
    assert sorted(map(tuple, got.matches.select(*columns).collect())) == sorted(map(tuple, want.collect()))
    report = {r["query_id"]: r for r in got.report.collect()}
    assert all(r["scored"] + r["skipped"] == r["blocks"] for r in report.values())
    assert sum(r["skipped"] for r in report.values()) > 0


def test_nothing_to_find(spark, tmp_path):
    index = lexical_index.write(some_sections(spark, 10), str(tmp_path / "index"), KEY)
    questions = some_questions(spark)
    none = lexical.question_postings(questions.limit(0), lexical_index.titles(index))
    assert lexical_index.search(index, none, 4).matches.count() == 0
    empty = lexical_index.write(some_sections(spark).limit(0), str(tmp_path / "empty"), KEY)
    postings = lexical.question_postings(questions, lexical_index.titles(empty))
    assert lexical_index.search(empty, postings, 4).matches.count() == 0


def test_one_pass_over_the_sections(spark, tmp_path, monkeypatch):
    """Blocks come from one pass in small steps, without a join; asking gathers no pairs of words and needles."""
    monkeypatch.setattr(lexical_index, "BLOCKS", 2)
    joined = []
    join = type(spark.range(1)).join
    monkeypatch.setattr(type(spark.range(1)), "join", lambda *a, **k: (joined.append(a), join(*a, **k))[1])
    limit, sizes, set_conf = "spark.sql.execution.arrow.maxRecordsPerBatch", [], type(spark.conf).set
    monkeypatch.setattr(type(spark.conf), "set", lambda c, k, v: (sizes.append((k, int(v))) if k == limit else None, set_conf(c, k, v))[1])
    before = int(spark.conf.get(limit))
    sections = some_sections(spark)
    index = lexical_index.write(sections, str(tmp_path / "index"), KEY)
    assert not joined and sizes == [(limit, 2 << lexical_index.BLOCK_BITS), (limit, before)]
    width = 1 << lexical_index.BLOCK_BITS
    got = {}
    for r in index.blocks.collect():
        assert len(r["keys"]) <= width and len(r["top_word"]) == len(set(r["top_word"]))
        for i, (word, place) in enumerate(zip(r["post_word"], r["post_place"])):
            points = tuple(r[f"post_{p}"][i] for p in lexical_index.POINTS)
            got[(*r["keys"][place], r["top_word"][word])] = points
            assert all(x <= r[f"top_{p}"][word] for x, p in zip(points, lexical_index.POINTS))
    assert sorted(r[0] for r in index.titles.collect()) == sorted(r[0] for r in sections.filter("length(title) > 1").select("title").distinct().collect())
    want = lexical.section_postings(sections, KEY).collect()
    assert got == {tuple(r[:4]): tuple(r[4:]) for r in want}
    questions = some_questions(spark)
    matches = lexical_index.search(index, lexical.question_postings(questions, lexical_index.titles(index)), 4).matches
    columns = ["query_id", "rank", *KEY, "score"]
    assert sorted(map(tuple, matches.select(*columns).collect())) == sorted(map(tuple, lexical.search(questions, sections, 4, KEY).select(*columns).collect()))
