"""License scan and decontamination against plain searches."""

import random
import re

import pytest

from gleaner.llm import contamination, licenses
from tests.llm.helpers import as_set, documents, odd_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_base_phrases_at_every_place(spark):
    rng = random.Random(3)
    pool = ["mit", "license", "apache", "general", "public", "MIT", "é", "x"]
    rows = [(i, " ".join(rng.choice(pool) + rng.choice(["", "-", "\n"]) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    rows += odd_rows(4)
    want = []
    for doc_id, text in rows:
        w = words(text)
        found = []
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
        at = [i for i, _ in found]
        want.append((doc_id, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))))
    got = licenses.scan(documents(spark, rows))
    assert as_set(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    for r in got.collect():
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


@pytest.mark.parametrize(
    "expression, labels, freedom",
    [
        ("mit", {"mit"}, 1.0),
        ("MIT or GPL-2.0-only".lower(), {"mit", "gpl"}, 1.0),
        ("mit and gpl-2.0-only", {"mit", "gpl"}, 0.2),
        ("gpl-2.0-or-later with classpath-exception-2.0", {"gpl"}, 0.5),
        ("mit or (apache-2.0 and gpl-3.0-only)", {"mit", "apache", "gpl"}, 1.0),
        ("(mit or apache-2.0) and gpl-3.0-only", {"mit", "apache", "gpl"}, 0.2),
        ("mit or apache-2.0 and gpl-3.0-only", {"mit", "apache", "gpl"}, 1.0),
        ("mit and it is free", {"mit", "it"}, 0.3),
        ("lgpl-2.1+ trailing prose", {"lgpl"}, 0.5),
        ("(mit", None, None),
        ("and mit", None, None),
        ("", None, None),
    ],
)
def test_expressions(expression, labels, freedom):
    value = licenses.evaluate(expression)
    if labels is None:
        assert value is None
    else:
        assert value[0] == labels and value[1] == pytest.approx(freedom)


def test_tags_and_notices(spark):
    rows = [
        (1, "x\n// SPDX-License-Identifier: MIT OR Apache-2.0\ny"),
        (2, "Redistribution and use, in source and binary forms, are permitted"),
        (3, "SPDX-License-Identifier:"),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, rows)).collect()}
    assert got[1]["labels"] == "apache,mit" and got[1]["freedom"] == 1.0 and got[1]["n_base"] == 0
    assert got[2]["labels"] == "bsd" and got[2]["freedom"] is None
    assert got[3]["labels"] == "" and got[3]["score"] == 0


def brute_marks(rows, items, window=13):
    grams = {}
    for item_id, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + size]), set()).add(item_id)
    out = []
    for doc_id, text in rows:
        w = words(text)
        hit, found = set(), set()
        for gram, ids in grams.items():
            for i in range(len(w) - len(gram) + 1):
                if tuple(w[i : i + len(gram)]) == gram:
                    hit |= set(range(i, i + len(gram)))
                    found |= ids
        found.discard(None)
        out.append((doc_id, len(w), len(hit), sorted(map(str, found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_contamination(spark, block_bytes):
    rng = random.Random(8)
    pool = "a b c dé F".split()
    text = lambda n: " ".join(rng.choice(pool) + rng.choice(["", ","]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 5, 13, 15, 30]))) for i in range(6)] + [(7, None), (8, ""), (None, text(14)), (10, "a b b")]
    items.append((11, items[3][1]))
    rows = [(i, " ".join([text(rng.randint(0, 30)), rng.choice(items)[1] or "", text(rng.randint(0, 30))])) for i in range(60)]
    rows += odd_rows(9, 10)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.mark(documents(spark, rows), benchmark, block_bytes=block_bytes)
    assert as_set(got, "doc_id", "n_words", "n_hit", "items", "contaminated") == brute_marks(rows, items)
    docs = documents(spark, rows)
    kept = contamination.clean(docs, benchmark, block_bytes=block_bytes)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r[-1] for r in brute_marks(rows, items))
    assert contamination.mark(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0
    assert contamination.mark(docs.limit(0), benchmark).count() == 0
