"""Vectors as integer grids: which rows have a usable vector, and its entries on a grid."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a batch that are worked on at once, so that memory doesn't follow the width of the vectors.
ENTRIES_AT_ONCE = 1 << 20


def matrices(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The rows of an array column without nulls, as matrices of bounded size."""
    at_once = max(1, ENTRIES_AT_ONCE // max(width, 1))
    for start in range(0, len(column), at_once):
        part = column.slice(start, at_once)
        yield part.flatten().to_numpy().reshape(len(part), width)


def without(df: DataFrame, *names: str) -> list:
    """Columns of ``df`` but those named like ``names``, whose place new columns take."""
    taken = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]


def grid_vectors(
    df: DataFrame, vector: str, scale: int, offset: int, limit: Callable[[int], int]
) -> tuple[DataFrame, int]:
    """``df`` with the array of ``floor(scale * c) + offset`` of each entry c (as double) in the place of ``vector``, and
    the number of entries.

    Rows whose vector is null or empty or holds a null or non-finite entry are dropped; so are vectors shorter than the longest
    one, which lack entries. Products beyond ``limit(number of entries)`` in size are held there.
    """
    usable = (F.size(vector) > 0) & F.forall(
        F.col(vector).cast("array<double>"),
        lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))),
    )
    kept = df.where(usable)
    width = kept.agg(F.max(F.size(vector))).first()[0] or 0

    bound = float(limit(width))

    def place(c):
        held = F.least(F.greatest(c * F.lit(float(scale)), F.lit(-bound)), F.lit(bound))
        return F.floor(held).cast("long") + F.lit(offset).cast("long")

    grid = F.transform(F.col(vector).cast("array<double>"), place)
    return kept.where(F.size(vector) == width).withColumn(vector, grid), width
