"""Replays a table as a stream: parts that arrive one after the other, one micro-batch each."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from gleaner.session import materialise, scratch_folder

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PARTITIONS = "spark.sql.shuffle.partitions"


def arriving(rows: DataFrame, arrival: Column, parts: int) -> list[DataFrame]:
    """``rows`` cut by equal stretches of ``arrival`` (a number), in that order."""
    placed = materialise(rows.withColumn("_arrival", arrival.cast("double")))
    low, high = placed.agg(F.min("_arrival"), F.max("_arrival")).first()
    if low is None:
        return [rows.limit(0)]
    step = (high - low) / parts or 1.0
    number = F.least(F.floor((F.col("_arrival") - low) / step), F.lit(parts - 1))
    return [placed.where(number == i).drop("_arrival") for i in range(parts)]


def width(spark: SparkSession) -> int:
    """State partitions for a replay: one for each core, and 8 at least."""
    return max(8, spark.sparkContext.defaultParallelism)


def _parts_done(query: StreamingQuery) -> int:
    """Parts whose micro-batch has ended: the source numbers them from 0."""
    progress = query.lastProgress
    number = progress and re.search(r"\d+", str(progress["sources"][0]["endOffset"]))
    return int(number[0]) + 1 if number else 0


def replay(
    parts: Iterable[DataFrame],
    stream: Callable[[DataFrame], DataFrame],
    partitions: int | None = None,
    timers: bool = False,
) -> DataFrame:
    """All rows that ``stream`` emits when ``parts`` arrive in order.

    A stream with processing-time timers (``timers``) never runs out of batches; it is stopped when the last part is done.

    The state store keeps its number of partitions for good, so it is an argument (the session's shuffle partitions by
    default). Parts, checkpoints and results are in the shared folder, so the run survives lost executors.
    """
    parts = list(parts)
    spark, schema = parts[0].sparkSession, parts[0].schema
    source, sink, checkpoint = (scratch_folder(spark) for _ in range(3))
    for i, part in enumerate(parts):
        part.repartition(1).write.parquet(f"{source}/part={i:06d}")
    wanted = {_STATE_STORE: _ROCKSDB}
    if partitions:
        wanted[_PARTITIONS] = str(partitions)
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/part=*")
        made = stream(rows)
        sunk = made.writeStream.outputMode("append").format("parquet").option("path", sink)
        sunk = sunk.option("checkpointLocation", checkpoint)
        if timers:
            query = sunk.trigger(processingTime="0 seconds").start()
            while not query.awaitTermination(0.5) and _parts_done(query) < len(parts):
                pass
            query.stop()
        else:
            sunk.trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(made.schema).parquet(sink)
