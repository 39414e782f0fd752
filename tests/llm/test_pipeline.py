"""The pipeline against brute-force stages on a small folder of tables."""

import random

import corpus_pipeline
from tests.llm.helpers import prose
from tests.llm.test_duplicates import brute_removal, closure, plain_fingerprint
from tests.llm.test_scans import brute_marks


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(20, 80)).replace("idiot", "river") for _ in range(60)]
    rows, labels = [], []
    for i, text in enumerate(texts):
        toxic = i % 6 == 0
        rows.append((i, text + (" scum moron trash" if toxic else "")))
        labels.append((i, 1, int(toxic)))
    rows += [(100 + i, texts[i + 1]) for i in range(5)]  # copies
    rows += [(200 + i, prose(rng, 20) + " " + texts[7][:150]) for i in range(4)]  # repeated passages
    item = " ".join(f"item{k}" for k in range(14))
    rows += [(300, prose(rng, 30) + " " + item), (301, None), (302, "")]
    docs = spark.createDataFrame([(d, t, "en", f"src{(d or 0) % 3}", len(t or "")) for d, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = [(d, t) for d, t in rows if "scum" not in (t or "")]
    prints = [plain_fingerprint(t) for _, t in kept]
    n = len(kept)
    root = closure(range(n), [(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    least = {}
    for i in range(n):
        least[root[i]] = min(least.get(root[i], 1 << 60), kept[i][0])
    kept = [r for i, r in enumerate(kept) if least[root[i]] == r[0]]
    kept = [(d, None if t is None else k.decode("utf-8", "ignore")) for (d, t), (*_, k) in zip(kept, brute_removal(kept))]
    clean = {m[0] for m in brute_marks(kept, [(1, item)]) if not m[-1]}
    want = {d: t for d, t in kept if d in clean}

    seen, current = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path))
        assert current.columns == docs.columns, name
        path = str(tmp_path / f"out-{name}")
        current.write.parquet(path)
        current = spark.read.parquet(path)
        seen.append(current.count())
    assert {r["doc_id"]: r["text"] for r in current.collect()} == want
    assert all(r["n_chars"] == len(r["text"] or "") for r in current.collect())
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in final) == sorted(want)


def test_near_duplicates_keep_one_row_of_each_class(spark):
    rng = random.Random(12)
    a, b, c, d, e, f, g = (" ".join(rng.choice("abcdefghij") * 3 + str(rng.randint(0, 999)) for _ in range(60)) for _ in range(7))
    rows = [
        (None, a, "en"), (None, b, "en"), (None, b, "en"),  # without id: one of each class
        (5, c, "en"), (None, c, "en"), (9, c, "en"),  # an id goes before none
        (7, d, "en"), (7, d, "en"), (7, d, "de"),  # repeated rows: once, of the least other columns
        (3, e, "en"), (2, e, "en"), (3, f, "en"),  # one id, two classes
        (0, g, "en"), (None, None, "en"), (None, "", "en"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    want = [(None, a, "en"), (None, b, "en"), (5, c, "en"), (7, d, "de"), (2, e, "en"), (3, f, "en"), (0, g, "en"), (None, None, "en")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0
