"""Lines full of tags, and input columns that carry the names operators use inside."""

import time

import pytest

from gleaner.llm import byte_bpe, contamination, licenses, quality, token_counts
from tests.llm.helpers import documents


@pytest.mark.parametrize(
    ("line", "labels"),
    [
        ("SPDX-License-Identifier: mit " * 100_000, {"mit"}),
        ("SPDX-License-Identifier: " + "(" * 50_000 + "mit" + ")" * 50_000, {"mit"}),
        ("SPDX-License-Identifier: " + "mit or apache-2.0 and " * 50_000 + "x", {"mit", "apache", "x"}),
    ],
)
def test_long_lines_take_linear_time(line, labels):
    scanner = licenses.scanner(tuple(licenses.BASE.items()), tuple(licenses.NOTICES.items()), tuple(licenses.TAGS))
    scanner.scan(line[:1000])
    start = time.process_time()
    got = scanner.scan(line)
    assert time.process_time() - start < 5
    assert set(got[5].split(",")) == labels


def test_expression_ends_where_prose_begins():
    assert licenses.expression(["mit", "or", "(", "apache-2.0", ")", "this", "file"]) == ["mit", "or", "(", "apache-2.0", ")"]
    assert licenses.expression(["mit", "or"]) == ["mit"]
    assert licenses.expression(["(", "mit"]) == []
    assert licenses.expression([")"]) == []


def test_columns_named_like_internal_ones(spark):
    rows = [(1, "one two three mit license"), (2, None)]
    df = documents(spark, rows, extra=False).selectExpr("*", "7 AS __made", "8 AS __marked", "9 AS __score", "10 AS __MADE_")
    items = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    made = (
        licenses.scan(df),
        token_counts.count_tokens(df),
        contamination.mark(df, items),
        contamination.mark(df, spark.createDataFrame([(i, "two three " * 40) for i in range(3)], "item_id long, text string"), block_bytes=64),
        byte_bpe.round_trip_digests(df),
        quality.score(quality.with_statistics(df), 0.5),
    )
    for out in made:
        got = out.orderBy("doc_id").collect()
        assert [(r["__made"], r["__marked"], r["__score"], r["__MADE_"]) for r in got] == [(7, 8, 9, 10)] * 2
