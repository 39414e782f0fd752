"""Whitening by a dense eigensolver, codes by a full scan, with null, broken, short, equal and repeated vectors."""

import hashlib
import math

import numpy as np
import pytest

from gleaner.llm import vector_codes, whitening
from gleaner.llm.gnat import Gnat

BAD = [(900, 1, None), (901, 1, [None] + [0.5] * 31), (902, 2, [float("nan")] * 32), (903, 2, [float("inf")] * 32)]
BAD += [(904, None, []), (905, None, [0.25] * 31)]


def vectors(spark, rows):
    """Vectors with columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    return df.selectExpr("*", "vec_id AS x", "'n' AS n", "1 AS whitened", "2 AS row", "3 AS v", "4 AS code", "5 AS __made")


def some_rows(seed=3, n=90, width=32):
    rng = np.random.default_rng(seed)
    spread = np.geomspace(1, 0.2, width)
    rows = [(int(i), int(i % 4) or None, [float(c) for c in rng.standard_normal(width) * spread]) for i in range(n)]
    rows += [(n + i, 7, rows[0][2]) for i in range(20)]  # a common vector
    return rows + [rows[3], rows[3], (None, None, rows[5][2])]


def usable(rows, width=32):
    return [(i, y, np.array(v, np.float32).astype(float)) for i, y, v in rows if v and len(v) == width and None not in v and np.isfinite(v).all()]


def test_whitening_against_dense_solver(spark):
    rows = some_rows() + BAD
    got = whitening.components_of(vectors(spark, rows)).collect()
    good = usable(rows)
    x = np.floor(64 * np.array([v for _, _, v in good])).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    a = (n * fit - sums) / n
    values, dense = np.linalg.eigh(a.T @ a / n)
    values, dense = values[::-1], dense[:, ::-1]
    want = (n * x - sums) / n @ (dense[:, :16] / np.sqrt(values[:16]))
    assert len(got) == 16 * len(good) and {r["n"] for r in got} == {n}
    place = {i: k for k, (i, _, _) in enumerate(good)}
    signs = {}
    for r in got:
        k, c = place[r["vec_id"]], r["component"] - 1
        sign = signs.setdefault(c, math.copysign(1, want[0, c] * next(g["whitened"] for g in got if g["vec_id"] == good[0][0] and g["component"] == c + 1)))
        assert abs(r["whitened"] - sign * want[k, c]) < 1e-9
        assert r["deviation"] == int(((n * x[k] - sums) ** 2).sum())
        assert abs(r["explained"] - values[c] / values.sum()) < 1e-12 and r["identity_error"] < 1e-10
    assert {"x", "row", "__made", "code"} <= set(got[0].asDict())


def test_whitening_of_few_vectors(spark):
    one = [(1, 1, [0.5, 0.25]), (2, 1, [0.5, 0.25])]
    assert whitening.components_of(vectors(spark, one)).collect() == []
    assert whitening.components_of(vectors(spark, [])).collect() == []
    assert whitening.components_of(vectors(spark, [(1, 1, None), (2, 1, [])])).collect() == []
    line = [(i, 1, [float(i), float(i), 0.0]) for i in range(4)]  # one direction
    got = whitening.components_of(vectors(spark, line)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 4 and got[0]["explained"] == pytest.approx(1)


def test_leading_space_is_certified_in_passes():
    rng = np.random.default_rng(0)
    turn = np.linalg.qr(rng.standard_normal((300, 300)))[0]
    values = np.sort(np.concatenate([[50, 20, 20], rng.uniform(1, 2, 297)]))[::-1]
    v = turn * values @ turn.T
    calls = []

    def multiply(q):
        calls.append(q.shape[1])
        return v @ q

    found, vectors_ = whitening.leading(multiply, 300, 16)
    assert np.abs(found - values[:16]).max() < 1e-10
    assert np.linalg.norm(v @ vectors_ - vectors_ * found, axis=0).max() < 1e-11
    assert len(calls) < 250 and max(calls) == 40  # blocks only, never the whole matrix


def test_filter_is_the_chebyshev_polynomial():
    values = np.array([10.0, 5, 1, 0.5, 0.1])
    q = np.ones((5, 1))
    y = whitening.chebyshev_filter(lambda b: values[:, None] * b, q, values[:, None] * q, 0.0, 1.0, 10.0)[:, 0]
    degree = whitening.degree_for(10.0, 0.0, 1.0)
    of = np.polynomial.chebyshev.Chebyshev.basis(degree)
    assert np.allclose(y, of(2 * values - 1) / of(19.0), rtol=1e-12)
    assert 1e4 < of(19.0) <= whitening.AMPLIFICATION and abs(y[2:]).max() < 1.001 / of(19.0)


def test_deviation_beyond_a_long_is_null():
    x = np.array([[1 << 45, 0], [3, 4]])
    assert whitening.deviations(x, 1 << 20, [0, 0]) == [None, 25 << 40]
    assert whitening.deviations(x, 3, [1, 2]) == [None, 8**2 + 10**2]


@pytest.mark.parametrize("seed", range(12))
def test_gnat_is_a_full_scan(seed):
    rng = np.random.default_rng(seed)
    high = [2, 5, 40, 1 << 26][seed % 4]
    points = rng.integers(-high, high, (rng.integers(1, 70), rng.integers(1, 6)))
    if seed % 3 == 0:
        points = np.concatenate([points, points[:10], points[:1].repeat(9, 0)])  # ties
    queries = np.concatenate([points, rng.integers(-2 * high, 2 * high, (500, points.shape[1]))])
    tree = Gnat(points, degree=4, leaf=3)
    at, distance = tree.nearest(queries)
    full = ((queries[:, None].astype(object) - points[None].astype(object)) ** 2).sum(2)
    assert [int(d) for d in distance] == [int(min(row)) for row in full]
    assert at.tolist() == [int(np.argmin(row)) for row in full]


def test_gnat_leaves_out_subtrees():
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (8, 4))
    points = (centres[:, None] + rng.integers(-20, 20, (8, 12, 4))).reshape(-1, 4)
    queries = (centres[:, None] + rng.integers(-30, 30, (8, 400, 4))).reshape(-1, 4)
    tree = Gnat(points)
    tree.nearest(queries)
    assert tree.compared < 0.4 * len(queries) * len(points)


def full_codes(rows, parts=16, entries=64, rounds=2):
    good = usable(rows)
    v = [np.array([math.floor(256 * c) for c in x], dtype=object).reshape(parts, -1) for _, _, x in good]
    order = sorted(range(len(good)), key=lambda k: (good[k][0] is None, good[k][0] or 0, v[k].ravel().tolist()))
    books = [[v[k][p].tolist() for k in order[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for x in v:
                members.setdefault(nearest(x[p], books[p])[1], []).append(x[p])
            for i, own in members.items():
                books[p][i] = [sum(c) // len(own) for c in zip(*own)]
    found = [[nearest(x[p], books[p]) for p in range(parts)] for x in v]
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for (_, y, _), e in zip(good, errors):
        labels[y] = labels.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    codes = ["".join(f"{i:02x}" for _, i in f) for f in found]
    return sorted(((i, c, e, labels[y], digest) for (i, y, _), c, e in zip(good, codes, errors)), key=repr)


@pytest.mark.parametrize("n", [90, 10])
def test_codes_by_full_scan(spark, n):
    rows = some_rows(n=n) + BAD
    made = vector_codes.compress(vectors(spark, rows))
    assert {"x", "row", "v", "__made"} <= set(made.columns) and made.columns.count("code") == 1
    got = sorted((tuple(r) for r in made.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)
    assert got == full_codes(rows)


def test_codes_of_odd_tables(spark):
    assert vector_codes.compress(vectors(spark, [])).collect() == []
    assert vector_codes.compress(vectors(spark, BAD[:1] + BAD[4:5])).collect() == []
    with pytest.raises(ValueError):
        vector_codes.compress(vectors(spark, [(1, 1, [0.5] * 7)]))
    (one,) = vector_codes.compress(vectors(spark, [(1, None, [0.5] * 32)])).collect()
    assert (one["code"], one["error"], one["label_error"]) == ("00" * 16, 0, 0)
    books = vector_codes.Codebooks(np.arange(64, dtype=np.int64).reshape(16, 2, 2))
    assert books.restore("01" + "00" * 15) == [2, 3, *(c for p in range(1, 16) for c in (4 * p, 4 * p + 1))]
