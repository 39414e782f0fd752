"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The wanted components are the leading eigenvectors of a covariance that is never formed: the cluster only multiplies a
small block, ``V Q = Xᵀ(X Q) / n`` with centred rows, one pass over the fit list for each multiplication. A polynomial of
the covariance, applied by the three-term recurrence of the Chebyshev polynomials, stays small on the unwanted part of the
spectrum and grows steeply above it. QR and a Rayleigh-Ritz step turn the filtered block into better eigenvectors, and
their residuals decide whether another filter is needed.

The fit list has each distinct vector once. The driver holds blocks of ``dimensions × (components + BUFFER)`` numbers
only; their sums over tasks are a grouped aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.vector_rows import grid_vectors, matrices, without
from gleaner.session import materialise

SCALE, OFFSET = 64, 1_000_000
#: Grid values are held within this size, so that they and their sums in a batch stay exact.
GRID_LIMIT = 1 << 46
#: Columns of the block beyond the wanted components; the filter damps what lies below the last of them.
BUFFER = 24
#: Steps of the Lanczos run that estimates the lower end of the spectrum.
LANCZOS_STEPS = 10
#: Most that one filter may amplify the first component that isn't locked over the damped part: beyond it rounding drowns
#: the others.
AMPLIFICATION = 1e6
MAX_DEGREE = 16
#: A component is certified when its residual is at most this part of the first eigenvalue. Where rounding ends the
#: progress earlier, STALLED is enough; a fit that gets neither fails.
CERTIFIED, STALLED = 1e-13, 1e-10
MAX_FILTERS = 200

WHITENED = T.StructType([T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])


@dataclass
class Whitening:
    """``n`` fitted vectors, their exact sums, the components (columns) with eigenvalues, and how far whitening is off."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - sums/n`` with a single rounding: whole quotients are taken off as integers."""
    whole, rest = zip(*(divmod(s, n) for s in sums)) if sums else ((), ())
    return (x - np.array(whole, np.int64)) - np.array([r / n for r in rest])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact ``Σ (n·x - sums)²`` of each row; null where it doesn't fit a long."""
    whole, rest = zip(*(divmod(s, n) for s in sums)) if sums else ((), ())
    off = x - np.array(whole, np.int64)
    largest = int(np.abs(off).max(initial=0)) * n + n
    if largest * largest * max(1, x.shape[1]) < 1 << 62:
        t = off * n - np.array(rest, np.int64)
        return (t * t).sum(1).tolist()
    exact = [sum((n * o - r) ** 2 for o, r in zip(row, rest)) for row in off.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


class FitList:
    """Distinct grid vectors in the shared folder, with counted passes over them."""

    def __init__(self, grid: DataFrame, width: int, column: str = "x"):
        self.rows = materialise(grid.select(F.col(column).alias("x")).distinct())
        self.width = width
        self.n = self.rows.count()
        self.passes = 0
        self.sums: list[int] = self._integer_sums() if self.n else []

    def _integer_sums(self) -> list[int]:
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [0] * width
            for batch in batches:
                for x in matrices(batch.column(0), width):
                    total = [t + s for t, s in zip(total, x.sum(0).tolist())]
            high = [t >> 32 for t in total]
            low = [t & 0xFFFFFFFF for t in total]
            yield pa.RecordBatch.from_pydict({"place": pa.array(range(width), pa.int32()), "high": high, "low": low})

        parts = self.rows.mapInArrow(run, "place int, high long, low long").groupBy("place")
        out = [0] * width
        for r in parts.agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
            out[r["place"]] = (r["high"] << 32) + r["low"]
        return out

    def total(self, made: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """Sum over all rows of what ``made`` gives for centred batches, a matrix of ``shape``. One matrix leaves each
        task; the cluster adds them up."""
        self.passes += 1
        n, sums, width = self.n, self.sums, self.width
        names = [f"c{i}" for i in range(shape[1])]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            amount = np.zeros(shape)
            for batch in batches:
                for x in matrices(batch.column(0), width):
                    amount += made(centred(x, n, sums))
            columns = [pa.array(range(shape[0]), pa.int32()), *(pa.array(c) for c in amount.T)]
            yield pa.RecordBatch.from_arrays(columns, ["place", *names])

        schema = "place int, " + ", ".join(f"{c} double" for c in names)
        parts = self.rows.mapInArrow(run, schema).groupBy("place").agg(*[F.sum(c).alias(c) for c in names])
        out = np.zeros(shape)
        for r in parts.collect():
            out[r["place"]] = [r[c] for c in names]
        return out

    def multiply(self, q: np.ndarray) -> np.ndarray:
        """``V q`` for the covariance V."""
        return self.total(lambda a: a.T @ (a @ q), q.shape) / self.n


def lower_end(multiply: Callable, width: int, rng: np.random.Generator) -> float:
    """A value that the smallest eigenvalue hardly goes below, by a short Lanczos run."""
    basis = [rng.standard_normal((width, 1))]
    basis[0] /= np.linalg.norm(basis[0])
    alpha, beta = [], []
    for _ in range(min(width, LANCZOS_STEPS)):
        v = multiply(basis[-1])
        alpha.append(float((basis[-1].T @ v)[0, 0]))
        known = np.hstack(basis)
        for _ in range(2):  # against all, twice: rounding would bring found values back
            v = v - known @ (known.T @ v)
        size = float(np.linalg.norm(v))
        beta.append(size)
        if size <= 1e-12 * max(map(abs, alpha)):
            break
        basis.append(v / size)
    k = len(alpha)
    found, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta[: k - 1], 1) + np.diag(beta[: k - 1], -1))
    return max(0.0, float(found[0] - beta[k - 1] * abs(vectors[-1, 0])))


def degree_for(top: float, low: float, cut: float) -> int:
    """The degree at which a filter of [low, cut] amplifies ``top`` by AMPLIFICATION."""
    centre, half = (cut + low) / 2, max((cut - low) / 2, 1e-10 * top)
    growth = np.arccosh(max((top - centre) / half, 1 + 1e-12))
    return int(np.clip(np.log(2 * AMPLIFICATION) / growth, 2, MAX_DEGREE))


def chebyshev_filter(multiply: Callable, q: np.ndarray, vq: np.ndarray, low: float, cut: float, top: float) -> np.ndarray:
    """The scaled Chebyshev polynomial of V that is small on [low, cut], times ``q``; ``vq`` is V q, so that a filter
    of degree m costs m - 1 passes."""
    centre, half = (cut + low) / 2, max((cut - low) / 2, 1e-10 * top)
    sigma = first = half / (top - centre) if top > centre else 1.0
    before, now = q, (vq - centre * q) * (sigma / half)
    for _ in range(degree_for(top, low, cut) - 1):
        following = 1 / (2 / first - sigma)
        after = (multiply(now) - centre * now) * (2 * following / half) - (sigma * following) * before
        before, now, sigma = now, after, following
    return now


def rayleigh_ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best eigenvalues in the space of ``q``, falling, their vectors, V times these, and the norms of the residuals."""
    h = q.T @ vq
    values, turn = np.linalg.eigh((h + h.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    q, vq = q @ turn, vq @ turn
    return values, q, vq, np.linalg.norm(vq - q * values, axis=0)


def leading(multiply: Callable, width: int, components: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues and eigenvectors of a positive semi-definite operator, certified by their residuals.
    Those that are zero to double precision are left out.

    Certified vectors are locked: later blocks are kept orthogonal to them and no longer filter them, so that a steep
    start of the spectrum doesn't bound the filter's degree for the rest.
    """
    rng = np.random.default_rng(seed)
    size = min(width, components + BUFFER)
    q = np.linalg.qr(rng.standard_normal((width, size)))[0]
    values, q, vq, residuals = rayleigh_ritz(q, multiply(q))
    low = lower_end(multiply, width, rng) if size < width else 0.0
    locked, locked_values = np.zeros((width, 0)), np.zeros(0)
    worst, stalled = np.inf, 0
    for _ in range(MAX_FILTERS):
        top = max(float(values[0]), float(locked_values.max(initial=0.0)), 0.0)
        wanted = max(0, components - len(locked_values))
        real = int((values[:wanted] > 1e-13 * width * top).sum())
        now = float(residuals[:real].max(initial=0.0))
        stalled = stalled + 1 if now > 0.9 * worst else 0
        worst = min(now, worst)
        if size == width or now <= CERTIFIED * top or (stalled >= 3 and now <= STALLED * top):
            found = np.concatenate([locked_values, values[:real]])
            order = np.argsort(-found, kind="stable")
            return found[order], np.hstack([locked, q[:, :real]])[:, order]
        done = int(np.argmin(residuals[:real] <= CERTIFIED * top))  # leading ones only
        if done:
            locked, locked_values = np.hstack([locked, q[:, :done]]), np.concatenate([locked_values, values[:done]])
            values, q, vq = values[done:], q[:, done:], vq[:, done:]
            worst, stalled = np.inf, 0

        def rest(y: np.ndarray, known: np.ndarray = locked) -> np.ndarray:
            return y - known @ (known.T @ y)

        cut, highest = float(values[-1]), max(float(values[0]), float(values[-1]))
        y = chebyshev_filter(lambda b: rest(multiply(b)), q, rest(vq), min(low, cut), cut, highest)
        q = np.linalg.qr(rest(rest(y / np.linalg.norm(y, axis=0))))[0]
        values, q, vq, residuals = rayleigh_ritz(q, multiply(q))
    raise ArithmeticError(f"residual {worst:g} of eigenvalue {top:g} after {MAX_FILTERS} filters")


def fit(grid: DataFrame, width: int, components: int = 16, column: str = "x") -> Whitening | None:
    """The leading ``components`` of the distinct vectors in ``column``; None for an empty table.

    Fewer come out where the vectors have fewer dimensions or vary in fewer directions (one distinct vector: none, since
    a component without variance can't be whitened). Equal eigenvalues have no order of their own: any basis is right.
    """
    rows = FitList(grid, width, column)
    if not rows.n:
        return None
    trace = float(rows.total(lambda a: (a * a).sum(0)[:, None], (width, 1)).sum()) / rows.n
    if trace == 0:
        return Whitening(rows.n, rows.sums, np.zeros((width, 0)), np.zeros(0), 0.0, 0.0, rows.passes)
    values, vectors = leading(rows.multiply, width, components)
    to_unit = vectors / np.sqrt(values)
    covariance = rows.total(lambda a: (a @ to_unit).T @ (a @ to_unit), (len(values),) * 2) / rows.n
    error = float(np.abs(covariance - np.eye(len(values))).max())
    return Whitening(rows.n, rows.sums, vectors, values, trace, error, rows.passes)


def whiten(grid: DataFrame, model: Whitening, column: str = "x") -> DataFrame:
    """Adds ``deviation`` (exact sum of squares of ``n·x - S``; null beyond a long) and ``whitened``, an array with one
    number for each component. A narrow map; columns of these names are replaced."""
    n, sums, width = model.n, model.sums, len(model.sums)
    to_unit = model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            off, made = [], [np.zeros((0, to_unit.shape[1]))]
            for x in matrices(batch, width):
                off += deviations(x, n, sums)
                made.append(centred(x, n, sums) @ to_unit)
            places = pa.array(np.arange(len(off) + 1) * to_unit.shape[1], pa.int32())
            whitened = pa.ListArray.from_arrays(places, pa.array(np.concatenate(made).ravel()))
            yield pa.StructArray.from_arrays([pa.array(off, pa.int64()), whitened], ["deviation", "whitened"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    row = F.struct(*without(grid, "deviation", "whitened")).alias("row")
    return grid.select(row, F.arrow_udf(run, WHITENED)(column).alias("made")).select("row.*", "made.*")


def components_of(df: DataFrame, components: int = 16, vector: str = "embedding") -> DataFrame:
    """One row for each usable row of ``df`` and component, with the columns of ``df`` but ``vector``, and ``component``
    (from 1), ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``; columns of these names are replaced.

    Null and empty vectors and those with null, missing or non-finite entries are dropped; repeated rows each give rows, but count
    once in the fit; rows without id stay. An empty table, or one whose usable vectors are all equal, gives no rows.
    """
    made = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    held = df.select(F.struct(*without(df, vector, *made)).alias("row"), F.col(vector).alias("x"))
    grid, width = grid_vectors(held, "x", SCALE, OFFSET, lambda _: GRID_LIMIT)
    model = fit(grid, width, components)
    if model is None:
        model = Whitening(1, [0] * width, np.zeros((width, 0)), np.zeros(0), 0.0, 0.0, 0)
    parts = whiten(grid, model).select("row", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    explained = F.array(*[F.lit(e) for e in model.explained]).cast("array<double>")
    return parts.select(
        "row.*",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
