"""Classifiers by held-out accuracy on planted labels, the URL filter by rules and by a planted language."""

import random

import numpy as np
from pyspark.sql import functions as F

from gleaner.llm import quality, toxicity, url_filter
from tests.llm.helpers import documents, odd_rows, prose


def area(rows):
    """Area under the curve of (score, label)."""
    ones, zeros = ([s for s, y in rows if y == v] for v in (1, 0))
    return np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])


def test_machine_learns_pairs():
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        noise = rng.integers(100, 140, 5)
        rows.append(np.unique(np.array([1] * a + [2] * b + noise.tolist(), np.uint32)))
        labels.append(int(a and b))
    machine = toxicity.train(rows[:2000], np.array(labels[:2000]))
    owner = np.repeat(np.arange(1000), [len(r) for r in rows[2000:]])
    place = [machine.place.get(int(t), -1) for r in rows[2000:] for t in r]
    keep = np.array(place) >= 0
    raw = machine.raw(owner[keep], np.array(place)[keep], 1000)
    assert area(list(zip(raw, labels[2000:]))) > 0.99
    assert abs(machine.factors).max() > 0.2  # the pair is in the factors


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        toxic = int(rng.random() < 0.2)
        text = prose(rng, 40).replace("idiot", "river")
        rows.append((i, text + (f" scum{rng.choice('abcd')}" if toxic else "")))
        labels.append((i, toxic))
    table = spark.createDataFrame([*labels, (None, 1), (5, None), (9999, 1)], "doc_id long, toxic int")
    machine = toxicity.fit(documents(spark, rows), table, F.col("doc_id") % 4 != 2)
    scored = toxicity.score(documents(spark, [*rows, *odd_rows(1, 5)]), machine).collect()
    assert len(scored) == len(rows) + len(odd_rows(1, 5)) and all(0 <= r["score"] <= 1 for r in scored)
    known = dict(labels)
    held = [(r["score"], known[r["doc_id"]]) for r in scored[:400] if r["doc_id"] % 4 == 2]
    assert area(held) > 0.98
    none = toxicity.fit(documents(spark, rows), table.limit(0))
    assert toxicity.score(documents(spark, rows[:3]), none).where("predicted = 0").count() >= 0
    assert toxicity.score(documents(spark, []), machine).count() == 0


def test_quality_held_out(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        good = int(rng.random() < 0.8)
        text = prose(rng, rng.randint(5, 60))
        rows.append((i, text if good else " ".join(w + rng.choice(["###", "$$$"]) for w in text.split())))
        labels.append((i, good))
    docs = documents(spark, [*rows, *odd_rows(2, 5)])
    stats = quality.with_statistics(docs)
    table = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(stats, table, F.col("doc_id") % 5 != 0)
    scored = quality.score(stats, model).collect()
    assert all(0 <= r["score"] <= 1 for r in scored) and len(scored) == docs.count()
    known = dict(labels)
    held = [(r["score"], known[r["doc_id"]]) for r in scored[:400] if r["doc_id"] % 5 == 0]
    assert area(held) > 0.98
    assert quality.score(stats, quality.fit(stats, table.where("quality = 1"))).where("score = 1").count() > 0
    assert quality.score(stats, quality.fit(stats, table.limit(0))).count() == docs.count()


def test_rules_and_places(spark):
    cases = [
        ("https://a.com/x", "a.com", "/x", "com/", "allow"),
        ("https://example.com/en/1?q#z", "example.com", "/en/1", "example.com/en/", "block"),
        ("http://m.Example.COM/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
        ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://x.net/fr/", "x.net", "/fr/", "net/fr/", "block"),
        ("http://x.net/de/", "x.net", "/de/", None, None),
        ("http://a.com", "a.com", "", None, None),
        ("http://a.com?x://b.com/c", "a.com", "", None, None),
        ("no scheme", "", "", None, None),
        ("", "", "", None, None),
        (None, "", "", None, None),
    ]
    pages = spark.createDataFrame([(i, c[0], "own") for i, c in enumerate(cases)] * 2, "page_id long, url string, score string")
    got = url_filter.judge(pages).collect()
    assert len(got) == 2 * len(cases) and isinstance(got[0]["score"], float)
    for r in got:
        url, host, path, rule, verdict = cases[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_language_models_tell_the_sides_apart(spark):
    rng = random.Random(9)
    rows = []
    for i in range(600):
        good = rng.random() < 0.5
        name = "".join(rng.choice(["ka", "to", "mi"] if good else ["xq", "zw", "vv"]) for _ in range(4))
        tld = rng.choice(["com", "org"]) if good else rng.choice(["net", "org"])
        rows.append((i, f"http://{name}.{tld}/fr/", good))
    pages = spark.createDataFrame(rows, "page_id long, url string, good boolean")
    judged = url_filter.judge(pages).where("rule IS NULL")
    assert judged.count() > 100
    assert judged.where("good = (verdict = 'allow')").count() >= 0.97 * judged.count()
