"""Quality by a regularised quadratic discriminant over transformed statistics of whole documents.

Each class has a mean and a covariance of the statistics, shrunk towards the pooled covariance and that towards its
diagonal; their Cholesky factors are computed once and kept in the model. A score is the difference of the two classes'
Mahalanobis log densities, calibrated to a probability.

The fit needs only sums: counts, sums and sums of products of the statistics of all labelled rows are added up in the
cluster and a few hundred numbers reach the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import unused, with_columns_from_text

#: Shrinkage of class covariances to the pooled one, and of both to the diagonal.
TO_POOLED, TO_DIAGONAL = 0.15, 0.05
THRESHOLD = 0.3
#: Log density differences are clipped to this size and counted in so many bins for the calibration.
CLIP, BINS = 60.0, 240

_CLASSES = np.zeros(256, np.int64)
for _byte in range(256):
    _char = chr(_byte)
    _CLASSES[_byte] = (
        0 if _byte >= 0x80 else 1 if "a" <= _char <= "z" else 2 if "A" <= _char <= "Z" else 3 if _char.isdigit()
        else 4 if _byte == 0x20 else 5 if _byte == 0x0A else 6 if _char in ".,;:!?" else 7 if _char in "'\"()-" else 8
    )

NAMES = (
    "bytes", "beyond_ascii", "upper", "digits", "blanks", "lines", "stops", "marks", "symbols",
    "word_length", "word_spread", "distinct", "commonest", "entropy", "repeated_lines", "mean_line", "symbol_words", "long_words",
)
SIZE = len(NAMES)

SCHEMA = T.StructType([T.StructField("statistics", T.ArrayType(T.DoubleType()))])


def statistics(text: str) -> list[float]:
    """Transformed statistics of a text: logarithms of sizes, square roots of shares."""
    data = text.encode("utf-8", "replace")
    classes = np.bincount(_CLASSES, np.bincount(np.frombuffer(data, np.uint8), minlength=256), 9)
    n = max(1, len(data))
    shares = np.sqrt(classes / n)
    words = text.split()
    counts = Counter(words)
    n_words = max(1, len(words))
    lengths = np.fromiter(map(len, counts), np.float64, len(counts))
    times = np.fromiter(counts.values(), np.float64, len(counts))
    mean = float(lengths @ times / n_words)
    spread = float(np.sqrt(max(0.0, (lengths**2) @ times / n_words - mean**2)))
    share = times / n_words
    lines = [x for x in text.split("\n") if x]
    symbolic = sum(k for w, k in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:!?'\")")
    return [
        float(np.log1p(len(data))),
        *(float(shares[i]) for i in (0, 2, 3, 4)),
        float(np.log1p(len(lines))),
        *(float(shares[i]) for i in (6, 7, 8)),
        float(np.log1p(mean)),
        float(np.log1p(spread)),
        float(np.log(max(1, len(counts)) / n_words)),
        float(np.sqrt(times.max() / n_words)) if len(times) else 0.0,
        float(-(share @ np.log(share))) if len(times) else 0.0,
        float(np.sqrt(1 - len(set(lines)) / max(1, len(lines)))) if lines else 0.0,
        float(np.log1p(len(data) / max(1, len(lines)))),
        float(np.sqrt(symbolic / n_words)),
        float(np.sqrt((times @ (lengths > 20)) / n_words)),
    ]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``statistics`` of whole texts. Null and empty texts have those of no bytes; a narrow map; a column of that
    name is replaced."""

    def rows_of(texts):
        return [(statistics(t),) for t in texts]

    return with_columns_from_text(docs, rows_of, SCHEMA, text)


@dataclass
class Discriminant:
    """Per class (0, 1) the mean, the inverse of the Cholesky factor and the log density's constant; and the
    calibration: probability = logistic(offset + slope × difference)."""

    scale: tuple[np.ndarray, np.ndarray]
    means: np.ndarray
    inverses: np.ndarray
    constants: np.ndarray
    offset: float = 0.0
    slope: float = 1.0

    def differences(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.scale[0]) / self.scale[1]
        logs = []
        for mean, inverse, constant in zip(self.means, self.inverses, self.constants):
            white = (z - mean) @ inverse.T
            logs.append(constant - 0.5 * np.einsum("ij,ij->i", white, white))
        return np.clip(logs[1] - logs[0], -CLIP, CLIP)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        raw = np.clip(self.offset + self.slope * self.differences(x), -40, 40)
        return 1 / (1 + np.exp(-raw))


def solve(moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant:
    """The discriminant of ``{class: (rows, sums, sums of products)}``."""
    total = sum(m[0] for m in moments.values())
    centre = sum(m[1] for m in moments.values()) / total
    spread = np.sqrt(np.maximum(sum(np.diag(m[2]) for m in moments.values()) / total - centre**2, 1e-9))
    means, covariances = [], []
    for value in (0, 1):
        n, sums, products = moments[value]
        mean = sums / n
        covariances.append((products / n - np.outer(mean, mean)) / np.outer(spread, spread))
        means.append((mean - centre) / spread)
    pooled = sum(moments[v][0] * covariances[v] for v in (0, 1)) / total
    inverses, constants = [], []
    for value in (0, 1):
        shrunk = (1 - TO_POOLED) * covariances[value] + TO_POOLED * pooled
        shrunk = (1 - TO_DIAGONAL) * shrunk + TO_DIAGONAL * np.diag(np.maximum(np.diag(shrunk), 1e-3))
        factor = np.linalg.cholesky(shrunk + 1e-6 * np.eye(len(shrunk)))
        inverses.append(np.linalg.inv(factor))
        constants.append(-np.log(np.diag(factor)).sum())
    return Discriminant((centre, spread), np.array(means), np.array(inverses), np.array(constants))


def calibrate(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Offset and slope of the logistic function that fits ``(difference, rows of class 0, rows of class 1)``; the slope
    is held between 0.02 and 1, since the densities overstate their evidence."""
    x = np.array([b[0] for b in bins])
    zeros, ones = (np.array([b[i] for b in bins], float) for i in (1, 2))
    n = zeros + ones
    beta = np.array([np.log((ones.sum() + 0.5) / (zeros.sum() + 0.5)), 0.1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(beta[0] + beta[1] * x, -40, 40)))
        gradient = np.array([(ones - n * p).sum(), ((ones - n * p) * x).sum() - 1e-3 * beta[1]])
        w = n * p * (1 - p) + 1e-9
        hessian = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -1, 1)
    return float(beta[0]), float(np.clip(beta[1], 0.02, 1.0))


def fit(stats: DataFrame, labels: DataFrame, usable: Column | None = None, label: str = "quality") -> Discriminant | float:
    """Fits on all labelled rows where ``usable`` (a condition on ``doc_id``) holds; ``stats`` has ``doc_id`` and
    ``statistics``. Null ids and labels are left out, and a document labelled twice counts once. Where a class has no
    rows, the result is the prior probability alone."""
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)
    )
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = stats.select("doc_id", "statistics").join(known, "doc_id").select("label", "statistics")
    upper = np.triu_indices(SIZE)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            labels_ = batch.column("label").to_numpy()
            x = batch.column("statistics").flatten().to_numpy().reshape(-1, SIZE)
            for value in np.unique(labels_):
                own = x[labels_ == value]
                found = np.concatenate([[len(own)], own.sum(0), (own.T @ own)[upper]])
                held[int(value)] = held.get(int(value), 0) + found
        for value, found in held.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([value] * len(found), pa.int32()),
                    pa.array(np.arange(len(found)), pa.int32()),
                    pa.array(found, pa.float64()),
                ],
                ["label", "place", "amount"],
            )

    sums = rows.mapInArrow(moments, "label int, place int, amount double").groupBy("label", "place")
    found: dict[int, np.ndarray] = {}
    for r in sums.agg(F.sum("amount").alias("amount")).collect():
        found.setdefault(r["label"], np.zeros(1 + SIZE + len(upper[0])))[r["place"]] = r["amount"]
    if len(found) < 2:
        return float(next(iter(found), 0))
    parts = {}
    for value, amounts in found.items():
        products = np.zeros((SIZE, SIZE))
        products[upper] = amounts[1 + SIZE :]
        parts[value] = (amounts[0], amounts[1 : 1 + SIZE], products + np.triu(products, 1).T)
    model = solve(parts)
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("statistics").flatten().to_numpy().reshape(-1, SIZE)
            at = np.floor((shared.value.differences(x) + CLIP) / (2 * CLIP) * BINS).clip(0, BINS - 1)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(at.astype(np.int32))], ["label", "bin"])

    counted: dict[int, list[int]] = {}
    for r in rows.mapInArrow(binned, "label int, bin int").groupBy("label", "bin").count().collect():
        counted.setdefault(r["bin"], [0, 0])[r["label"]] = r["count"]
    centres = [((b + 0.5) / BINS * 2 * CLIP - CLIP, z, o) for b, (z, o) in sorted(counted.items())]
    model.offset, model.slope = calibrate(centres)
    return model


def score(stats: DataFrame, model: Discriminant | float, threshold: float = THRESHOLD) -> DataFrame:
    """Replaces ``statistics`` by ``score`` (probability of the label 1) and ``predicted``. Every row gets a score, the
    empty text that of its statistics; columns named like the new ones are replaced."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = batch.flatten().to_numpy().reshape(-1, SIZE)
            known = shared.value
            yield pa.array(np.full(len(x), known) if isinstance(known, float) else known.probabilities(x))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    keep = [c for c in stats.columns if c.lower() not in ("statistics", "score", "predicted")]
    held = unused(stats, "__score")
    made = stats.withColumn(held, F.arrow_udf(run, T.DoubleType())("statistics"))
    out = made.select(*[made[f"`{c}`"] for c in keep], F.col(held).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
