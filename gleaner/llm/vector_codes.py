"""Vector code compression: product codes whose nearest entries a GNAT finds.

Vectors become integers and are cut into equal parts; each part position has a codebook that starts from the vectors of
the smallest ids and moves by a few rounds of assignment and integer means. All arithmetic is on integers, so the result
doesn't depend on how Spark deals the rows. A round sends, from each task, one row for each used entry; what the driver
holds is the codebooks, ``parts × entries`` rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.gnat import Gnat
from gleaner.llm.vector_rows import grid_vectors, matrices, without
from gleaner.session import bounded_broadcast, materialise

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
CODED = T.StructType([T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])


@dataclass
class Codebooks:
    """``entries[part, index]`` is an entry's integer components."""

    entries: np.ndarray

    @property
    def sha256(self) -> str:
        """Digest of all components in decimal, by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def trees(self) -> list[Gnat]:
        return [Gnat(part) for part in self.entries]

    def restore(self, code: str) -> list[int]:
        """The integer vector that a code stands for."""
        return [c for part, i in zip(self.entries, bytes.fromhex(code)) for c in part[i].tolist()]


def largest_component(width: int) -> int:
    """Size of integer components at which squared distances over a whole vector still fit a long."""
    return math.isqrt((1 << 60) // max(width, 1))


def train(
    grid: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
    key: str = "vec_id", column: str = "v",
) -> Codebooks:
    """Codebooks of the integer vectors in ``column``.

    They start from the rows with the smallest keys, ascending (null keys last, equal keys by their vectors); a table of
    fewer rows has as few entries. An entry that no part is nearest to stays. ``width`` must be a multiple of ``parts``.
    """
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    if entries > 256:
        raise ValueError("two hex digits name 256 entries at most")
    first = grid.orderBy(F.col(key).asc_nulls_last(), F.col(column)).select(column).limit(entries).collect()
    start = np.array([r[0] for r in first], np.int64).reshape(len(first), parts, width // parts)
    books = Codebooks(start.transpose(1, 0, 2).copy())
    if first:
        for _ in range(rounds):
            books = _moved(grid.select(F.col(column).alias("v")), width, books)
    return books


def _moved(vectors: DataFrame, width: int, books: Codebooks) -> Codebooks:
    """The codebooks after one round."""
    parts, entries, size = books.entries.shape
    names = [f"s{i}" for i in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.trees()
        counts = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, size), np.int64)
        for v in (m.reshape(-1, parts, size) for batch in batches for m in matrices(batch.column(0), width)):
            for p, tree in enumerate(trees):
                at, _ = tree.nearest(v[:, p])
                counts[p] += np.bincount(at, minlength=entries)
                np.add.at(sums[p], at, v[:, p])
        part, entry = np.nonzero(counts)
        columns = [part.astype(np.int32), entry.astype(np.int32), counts[part, entry], *sums[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "entry", "n", *names])

    schema = "part int, entry int, n long, " + ", ".join(f"{s} long" for s in names)
    totals = vectors.mapInArrow(run, schema).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
    out = books.entries.copy()
    for r in totals.collect():
        out[r["part"], r["entry"]] = [r[s] // r["n"] for s in names]
    return Codebooks(out)


def encode(grid: DataFrame, width: int, books: Codebooks, column: str = "v") -> DataFrame:
    """Adds ``code`` (two hex digits for each part) and ``error`` (squared distances to the entries, summed). A narrow
    map; columns of these names are replaced."""
    parts = books.entries.shape[0]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trees = books.trees()
        for batch in batches:
            codes, errors = [], [np.zeros(0, np.int64)]
            for v in (m.reshape(len(m), parts, -1) for m in matrices(batch, width)):
                found = [tree.nearest(v[:, p]) for p, tree in enumerate(trees)]
                at = np.stack([f[0] for f in found], 1).astype(np.uint8)
                codes += [row.tobytes().hex() for row in at]
                errors.append(sum(f[1] for f in found))
            columns = [pa.array(codes, pa.string()), pa.array(np.concatenate(errors), pa.int64())]
            yield pa.StructArray.from_arrays(columns, ["code", "error"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    row = F.struct(*without(grid, "code", "error")).alias("row")
    return grid.select(row, F.arrow_udf(run, CODED)(column).alias("made")).select("row.*", "made.*")


def compress(df: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """``df`` without ``vector``, with ``code``, ``error``, ``label_error`` and ``codebooks_sha256``; columns of these names
    are replaced.

    Null and empty vectors and those with null, missing or non-finite components are dropped; integer components are held at
    ``largest_component``. Repeated rows and rows without key are coded like others; null labels are summed together. An
    empty table gives no rows. Errors of a label are summed before they are shuffled, and the sums, one row for each
    label, are broadcast within the session's measured bound.
    """
    made = ("code", "error", "label_error", "codebooks_sha256")
    row = F.struct(*without(df, vector, *made)).alias("row")
    held = df.select(row, F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("v"))
    grid, width = grid_vectors(held, "v", SCALE, 0, largest_component)
    grid = materialise(grid)
    books = train(grid, width, key="key")
    coded = materialise(encode(grid, width, books).select("row", "label", "code", "error"))
    sums = coded.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(bounded_broadcast(sums), coded["label"].eqNullSafe(F.col("same")))
    return joined.select("row.*", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
