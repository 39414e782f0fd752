"""Vector arithmetic in DOUBLE, in array order, so results do not depend on how rows were shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import col


def _double(c: Column | str) -> Column:
    return F.coalesce(col(c), F.array().cast("array<float>")).cast("array<double>")


def dot(left: Column | str, right: Column | str) -> Column:
    products = F.zip_with(_double(left), _double(right), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def squared_norm(vector: Column | str) -> Column:
    return F.aggregate(_double(vector), F.lit(0.0), lambda acc, x: acc + x * x)


def cosine(
    left: Column | str, right: Column | str, left_sq: Column | None = None, right_sq: Column | None = None
) -> Column:
    """Cosine similarity; 0 for empty, unequally long or zero vectors. Pass stored squared norms to save work."""
    l_sq = squared_norm(left) if left_sq is None else left_sq
    r_sq = squared_norm(right) if right_sq is None else right_sq
    usable = (
        (F.coalesce(F.size(col(left)), F.lit(0)) > 0)
        & (F.size(col(left)) == F.size(col(right)))
        & (l_sq > 0)
        & (r_sq > 0)
    )
    return F.when(usable, dot(left, right) / F.sqrt(l_sq * r_sq)).otherwise(F.lit(0.0))
