"""Ordered operators that survive a hot key.

A plain window puts every row of a key into one task. Here a key's rows are cut into order blocks first: the window
runs inside ``(key, block)``, and only one summary row per block is carried across the blocks of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def order_block(order: Column | str, size: int = BLOCK) -> Column:
    """Block number of a numeric order column."""
    return F.floor((F.col(order) if isinstance(order, str) else order) / size)


def previous_rows(
    rows: DataFrame, key: Sequence[str], order: str, payload: Column, n: int, out: str, block: Column | None = None
) -> DataFrame:
    """Add ``out``: the payloads of up to ``n`` earlier rows of the key, oldest first (``order`` must be unique per key)."""
    blocked = rows.withColumn("_block", order_block(order) if block is None else block).withColumn("_p", payload)
    inside = Window.partitionBy(*key, "_block").orderBy(order)
    near = blocked.withColumn("_near", F.collect_list(F.struct(F.col("_p").alias("v"))).over(inside.rowsBetween(-n, -1)))
    # The last n payloads of each block; n earlier non-empty blocks are always enough to fill a frame of n rows.
    back = Window.partitionBy(*key, "_block").orderBy(F.col(order).desc())
    tails = (
        blocked.withColumn("_r", F.row_number().over(back))
        .filter(F.col("_r") <= n)
        .groupBy(*key, "_block")
        .agg(F.array_sort(F.collect_list(F.struct(-F.col("_r").alias("r"), F.col("_p").alias("v")))).alias("_tail"))
        .withColumn("_tail", F.transform("_tail", lambda t: F.struct(t["v"].alias("v"))))
    )
    across = Window.partitionBy(*key).orderBy("_block").rowsBetween(-n, -1)
    halo = tails.withColumn("_halo", F.flatten(F.collect_list("_tail").over(across))).drop("_tail")
    joined = near.join(halo, [*key, "_block"], "left")
    frame = F.concat(F.coalesce("_halo", F.array().cast(halo.schema["_halo"].dataType)), "_near")
    last = F.when(F.size(frame) > n, F.slice(frame, -n, n)).otherwise(frame)
    return joined.withColumn(out, F.transform(last, lambda t: t["v"])).drop("_block", "_p", "_near", "_halo")


def carry_forward(
    rows: DataFrame, key: Sequence[str], order: str, value: Column, out: str, block: Column | None = None
) -> DataFrame:
    """Add ``out``: the last non-null ``value`` of the earlier rows of the key."""
    blocked = rows.withColumn("_block", order_block(order) if block is None else block).withColumn("_v", value)
    inside = Window.partitionBy(*key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    near = blocked.withColumn("_near", F.last("_v", ignorenulls=True).over(inside))
    # max_by ignores rows whose ordering value is null, so nulls of the carried value are ranked out.
    known = blocked.filter(F.col("_v").isNotNull()).groupBy(*key, "_block").agg(F.max_by("_v", order).alias("_last"))
    heads = blocked.select(*key, "_block").distinct().join(known, [*key, "_block"], "left")
    across = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    halo = heads.withColumn("_halo", F.last("_last", ignorenulls=True).over(across)).drop("_last")
    joined = near.join(halo, [*key, "_block"])
    return joined.withColumn(out, F.coalesce("_near", "_halo")).drop("_block", "_v", "_near", "_halo")


def running_max(
    rows: DataFrame, key: Sequence[str], order: str, value: str, out: str, block: Column | None = None
) -> DataFrame:
    """Add ``out``: the highest ``value`` of the key up to and including the row."""
    blocked = rows.withColumn("_block", order_block(order) if block is None else block)
    inside = Window.partitionBy(*key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    near = blocked.withColumn("_near", F.max(value).over(inside))
    tops = blocked.groupBy(*key, "_block").agg(F.max(value).alias("_top"))
    across = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    halo = tops.withColumn("_halo", F.max("_top").over(across)).drop("_top")
    joined = near.join(halo, [*key, "_block"])
    return joined.withColumn(out, F.greatest("_near", "_halo")).drop("_block", "_near", "_halo")


def keep_latest(rows: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """Rows carrying the highest version of their key: a map-side maximum joined back, instead of a window."""
    latest = rows.groupBy(*key).agg(F.max(version).alias("_latest"))
    return rows.join(latest, list(key)).filter(F.col(version) == F.col("_latest")).drop("_latest")
