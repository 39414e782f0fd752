"""Sharding by longest-processing-time scheduling: groups of equal texts, largest first, go to the least-loaded shard.

The schedule needs only how many groups have which size. Distinct sizes add up to at most the table's bytes, so there are
at most √(2 · bytes) of them (8 million for 32 TB); they stream through the driver in falling order, and the heap, with
one load for each shard, is all that stays there. A run of equal sizes is dealt at once, with the same outcome as one by
one. Which groups of a size go to which shard follows from their rank by smallest id.

Ranks and slots come from a range partitioning and the counts of its parts, so that neither a size, a shard nor a group
is gathered in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from gleaner.llm.common import shuffle_partitions
from gleaner.llm.vector_rows import without
from gleaner.session import bounded_broadcast, materialise

LAW = "bytes"
#: A group of at least this part of all rows is joined by broadcast; there are no more such groups than its inverse.
HOT_PART = 1000
#: Runs of equal sizes that the driver holds at once.
RUNS_AT_ONCE = 250_000
MADE = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
GROUP = ("same", "text_crc32", "size")


class Schedule:
    """Loads of the shards in a heap; equal loads go by the lower shard."""

    def __init__(self, shards: int):
        self.heap = [(0, s) for s in range(shards)]

    @property
    def loads(self) -> dict[int, int]:
        return {s: load for load, s in self.heap}

    def deal(self, size: int, count: int) -> list[int]:
        """How many of ``count`` items of one size each shard gets, when each goes to the least-loaded one in turn."""
        shards = len(self.heap)
        out = [0] * shards
        while count:
            load, shard = heapq.heappop(self.heap)
            highest = max(self.heap, default=(load, shard))[0]
            if count >= shards and highest - load < size:  # level: whole rounds keep the order
                rounds, count = divmod(count, shards)
                self.heap = [(at + rounds * size, s) for at, s in [(load, shard), *self.heap]]
                heapq.heapify(self.heap)
                out = [n + rounds for n in out]
                continue
            given = count
            if self.heap:  # until the next shard's turn
                following, other = self.heap[0]
                given = min(count, (following - load) // size + 1 if shard < other else -(-(following - load) // size))
            out[shard] += given
            count -= given
            heapq.heappush(self.heap, (load + given * size, shard))
        return out


def run_ends(runs: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """For runs ``(size, groups)`` in falling order, the rank at which each shard's groups of that size end."""
    schedule = Schedule(shards)
    for size, count in runs:
        ends, at = [], 0
        for n in schedule.deal(size, count):
            at += n
            ends.append(at)
        yield size, ends


def _run_table(runs: DataFrame, shards: int) -> DataFrame:
    """``(bytes, ends)`` of ``runs(bytes, n)``, in parts of bounded size."""
    spark = runs.sparkSession
    schema = pa.schema([("bytes", pa.int64()), ("ends", pa.list_(pa.int64()))])
    parts, held = [], []

    def flush() -> None:
        columns = [pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.list_(pa.int64()))]
        parts.append(materialise(spark.createDataFrame(pa.Table.from_arrays(columns, schema=schema))))
        held.clear()

    ordered = materialise(runs.orderBy(F.col("bytes").desc()))
    falling = ordered.orderBy(F.col("bytes").desc()).toLocalIterator(prefetchPartitions=True)
    for row in run_ends(((r["bytes"], r["n"]) for r in falling), shards):
        held.append(row)
        if len(held) >= RUNS_AT_ONCE:
            flush()
    if held or not parts:
        flush()
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def numbered(df: DataFrame, by: str, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """``df`` in the shared folder with ``part`` and ``place``, and ``(by, part, first, before)`` for each value of ``by``
    in a part: a row's number within its value of ``by``, in ``order``, is ``place - first + before``.

    ``order`` must tell all rows apart, so that rows of one value spread over parts.
    """
    dealt = df.repartitionByRange(shuffle_partitions(df.sparkSession), F.col(by), *order)
    dealt = dealt.sortWithinPartitions(F.col(by), *order).withColumn("place", F.monotonically_increasing_id())
    rows = materialise(dealt.withColumn("part", F.shiftright("place", 33)))
    parts = rows.groupBy(by, "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = W.Window.partitionBy(by).orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    return rows, parts.select(by, "part", "first", before)


def place(
    docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id", keep: Sequence[str] | None = None
) -> DataFrame:
    """``docs`` (all columns, or those in ``keep``) with ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``law``, ``shard``,
    ``slot`` (from 0 in each shard, by id, rows without id last) and ``grown_shard`` (null); columns of these names are
    replaced.

    Equal texts share a shard. A null text has no bytes and goes with the empty texts. Repeated rows have slots of their
    own. Fewer groups than shards leave shards empty; an empty table stays empty. Groups are told apart by two hashes and
    the size: should two texts agree in all of them, they stay together. A group larger than a shard's share makes its
    shard the largest; the others are level without it.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    carried = without(docs if keep is None else docs.select(*keep), *MADE)
    slim = materialise(
        docs.select(
            F.struct(*carried).alias("row"),
            F.col(key).alias("id"),
            (F.octet_length(whole).cast("long") + 1).alias("size"),
            F.crc32(whole.cast("binary")).alias("text_crc32"),
            F.xxhash64(whole).alias("same"),
            F.monotonically_increasing_id().alias("at"),
        )
    )
    groups = slim.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("least"))
    groups = groups.withColumn("bytes", F.col("rows") * F.col("size"))
    total = slim.count()
    order = [F.col("least").asc_nulls_last(), *(F.col(c) for c in GROUP)]
    ranked, parts = numbered(groups, "bytes", order)
    runs = ranked.groupBy("bytes").agg(F.count(F.lit(1)).alias("n"))
    ends = _run_table(runs, shards)
    parts = materialise(parts.join(bounded_broadcast(ends), "bytes"))
    rank = F.col("place") - F.col("first") + F.col("before")
    shard = F.size(F.filter("ends", lambda end: end <= rank)).alias("shard")
    placed = materialise(ranked.join(bounded_broadcast(parts), ["bytes", "part"]).select(*GROUP, "rows", shard))

    hot = F.broadcast(placed.where(F.col("rows") * HOT_PART >= total).drop("rows"))
    rest = placed.where(F.col("rows") * HOT_PART < total).drop("rows")
    joined = slim.join(hot, list(GROUP)).unionByName(slim.join(hot, list(GROUP), "left_anti").join(rest, list(GROUP)))
    order = [F.col("id").asc_nulls_last(), F.col("at")]
    rows, parts = numbered(materialise(joined), "shard", order)
    rows = rows.join(bounded_broadcast(parts), ["shard", "part"])
    return rows.select(
        "row.*",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("place") - F.col("first") + F.col("before")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, **options) -> None:
    """Writes the placed rows, texts included, as one folder ``shard=…`` for each shard."""
    place(docs, shards, **options).write.partitionBy("shard").parquet(path)
