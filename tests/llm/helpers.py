"""Small tables with the cases every operator must take: nulls, empty and long texts, ties, repeated rows."""

import random

WORDS = "the of stone river mit license apache general public idiot Österreich naïve 東京 x1 42 over under".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))


def documents(spark, rows, extra=True):
    """Documents with columns whose names clash with operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        df = df.selectExpr("*", "'en' AS lang", "doc_id AS n_tokens", "text AS score", "1 AS key", "2 AS component", "3 AS items")
    return df


def odd_rows(seed: int = 1, n: int = 30):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(0, 60))) for i in range(n)]
    rows += rows[:3]  # repeated rows
    rows += [(n + 1, rows[0][1]), (n + 2, rows[0][1]), (None, rows[1][1]), (None, None), (n + 3, None), (n + 4, "")]
    rows += [(n + 5, " \n\t "), (n + 6, prose(rng, 20_000)), (n + 7, "a" * 30_000), (n + 8, "é\U0001F600\x00" * 50)]
    return rows


def as_set(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
