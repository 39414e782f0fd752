"""Silence sessions, frame health and signal operators, for batch tables and (where noted) streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner import lexicons as lx
from gleaner.operators import ordered


def _gap(ms: int) -> str:
    return f"{ms} milliseconds"


def silence_sessions(
    events: DataFrame,
    key: Sequence[str],
    ts: str,
    complete: Column,
    complete_ms: int = lx.COMPLETE_DELAY_MS,
    forced_ms: int = lx.FORCED_COMMIT_MS,
    aggregates: Sequence[Column] = (),
    block: Column | None = None,
) -> DataFrame:
    """Sessions ended by silence: a short gap after a complete text, a long one otherwise.

    Works on a stream with a watermark on ``ts`` as well. With ``block`` (of the order of ``ts``, a day for example) a
    batch is cut into blocks, so that the rows of a hot key are spread over its blocks and its sessions.
    """
    if block is not None:
        ends = F.col(ts) + F.when(complete, F.expr(f"make_dt_interval(0, 0, 0, {complete_ms} / 1000.0)")).otherwise(
            F.expr(f"make_dt_interval(0, 0, 0, {forced_ms} / 1000.0)")
        )
        return _islands(events, key, ts, ends, "committed", aggregates, block)
    gap = F.when(complete, _gap(complete_ms)).otherwise(_gap(forced_ms))
    window = F.session_window(F.col(ts), gap).alias("session")
    grouped = events.groupBy(*key, window).agg(F.count(F.lit(1)).alias("n"), *aggregates)
    return grouped.select(
        *key, F.col("session.start").alias("started"), F.col("session.end").alias("committed"), *grouped.columns[len(key) + 1 :]
    )


def voice_sessions(
    events: DataFrame,
    key: Sequence[str],
    ts: str,
    voiced: Column,
    silence_ms: int = lx.SILENCE_MS,
    aggregates: Sequence[Column] = (),
    block: Column | None = None,
) -> DataFrame:
    """Submissions of a capture: any voice, then a fixed silence since the last voiced row. ``block`` as above."""
    if block is not None:
        ends = F.col(ts) + F.expr(f"make_dt_interval(0, 0, 0, {silence_ms} / 1000.0)")
        return _islands(events.filter(voiced), key, ts, ends, "submitted", aggregates, block)
    grouped = events.filter(voiced).groupBy(*key, F.session_window(F.col(ts), _gap(silence_ms)).alias("session"))
    summed = grouped.agg(F.count(F.lit(1)).alias("n"), *aggregates)
    return summed.select(
        *key, F.col("session.start").alias("started"), F.col("session.end").alias("submitted"), *summed.columns[len(key) + 1 :]
    )


def _islands(
    events: DataFrame, key: Sequence[str], ts: str, ends: Column, out: str, aggregates: Sequence[Column], block: Column
) -> DataFrame:
    """Rows whose stretches ``[ts, ends)`` touch, as one row each: an island opens where no earlier stretch is still open.

    Rows are dealt once, by key and block, and find their island within the block. Of a block only its highest end and the
    start of its last island matter to later blocks: one summary row, carried across the blocks of a key. An island whose
    start lies before the highest earlier end belongs to the last island that opened in an earlier block.
    """
    held = events.withColumns({"_end": ends, "_block": block, "_at": F.unix_micros(F.col(ts).cast("timestamp"))})
    inside = Window.partitionBy(*key, "_block").orderBy("_at")
    # Rows of one time are one row for this purpose: an earlier end is the end of a strictly earlier row.
    open_until = F.max("_end").over(inside.rangeBetween(Window.unboundedPreceding, -1))
    opened = held.withColumn("_open", F.when(open_until.isNull() | (F.col(ts) >= open_until), F.col(ts)))
    near = opened.withColumn("_near", F.max("_open").over(inside.rangeBetween(Window.unboundedPreceding, 0)))
    blocks = near.groupBy(*key, "_block").agg(F.max("_end").alias("_top"), F.max("_near").alias("_last"))
    across = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("_carry", F.max("_top").over(across))
    own = F.when(F.col("_carry").isNull() | (F.col("_last") >= F.col("_carry")), F.col("_last"))
    carried = carried.withColumn("_before", F.max(own).over(across)).select(*key, "_block", "_carry", "_before")
    joined = near.join(carried, [*key, "_block"])
    starts_here = F.col("_carry").isNull() | (F.col("_near") >= F.col("_carry"))
    island = F.when(starts_here, F.col("_near")).otherwise(F.col("_before"))
    made = joined.groupBy(*key, island.alias("started")).agg(F.max("_end").alias(out), F.count(F.lit(1)).alias("n"), *aggregates)
    return made.select(*key, "started", out, "n", *made.columns[len(key) + 3 :])


def frame_gaps(
    frames: DataFrame, key: Sequence[str], ts: str, gap_ms: int = lx.FRAME_GAP_MS, block: Column | None = None
) -> DataFrame:
    """Add ``gap_ms`` since the previous frame of the key and ``stale`` where it exceeds the limit.

    Rows are blocked by day, so a stream with very many frames is spread over its days.
    """
    day = F.date_trunc("day", F.col(ts)) if block is None else block
    before = ordered.previous_rows(frames, list(key), ts, F.col(ts), 1, "_before", block=day)
    previous = F.try_element_at(F.col("_before"), F.lit(1))
    micros = F.unix_micros(F.col(ts)) - F.unix_micros(previous)
    gap = before.withColumn("gap_ms", F.floor(micros / 1000)).drop("_before")
    return gap.withColumn("stale", F.coalesce(F.col("gap_ms") > gap_ms, F.lit(False)))


def throttle(alarms: DataFrame, key: Sequence[str], ts: str, every_ms: int = lx.RECOVERY_MS) -> DataFrame:
    """Keep an alarm only if more than ``every_ms`` passed since the last one kept for its key.

    An alarm that comes more than ``every_ms`` after the alarm before it is kept in any case, so what lies between two such
    alarms is decided on its own. Those runs, not the keys, are partitioned and sorted by Spark and streamed through one
    small state; they are found by a look at the previous row and a running maximum, both blocked.
    """
    partitions = int(alarms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    day = F.date_trunc("day", F.col(ts))
    before = ordered.previous_rows(alarms, list(key), ts, F.col(ts), 1, "_before", block=day)
    micros = F.unix_micros(F.col(ts)) - F.unix_micros(F.try_element_at(F.col("_before"), F.lit(1)))
    opens = before.withColumn("_open", F.when(micros.isNull() | (micros > every_ms * 1000), F.col(ts))).drop("_before")
    runs = ordered.running_max(opens, list(key), ts, "_open", "_run", block=day)
    runs = runs.select(*alarms.columns, "_run")
    routed = runs.repartition(partitions, *key, "_run").sortWithinPartitions(*key, "_run", ts)
    names = [*key, "_run", ts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, None
        wait = pd.Timedelta(milliseconds=every_ms)
        for frame in batches:
            keep = []
            for values in frame[names].itertuples(index=False):
                name, at = tuple(values[:-1]), values[-1]
                if name != current:
                    current, last = name, None
                ok = last is None or at - last > wait
                if ok:
                    last = at
                keep.append(ok)
            yield frame[pd.Series(keep, index=frame.index, dtype=bool)].drop(columns="_run")

    return routed.mapInPandas(run, alarms.schema)


def frame_rms(samples: Column | str) -> Column:
    """Root mean square of a frame held as an array, summed in order."""
    c = F.col(samples) if isinstance(samples, str) else samples
    squares = F.aggregate(c.cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x * x)
    return F.when(F.size(c) > 0, F.sqrt(squares / F.size(c))).otherwise(F.lit(0.0))


def is_voiced(rms: Column, threshold: float = lx.VOICE_RMS) -> Column:
    return rms > threshold


def grouped_rms(signal: DataFrame, key: Sequence[str | Column], sample: str) -> DataFrame:
    """The same over one row per sample: combined on the map side, so a long frame never sits in one task."""
    return signal.groupBy(*key).agg(F.sqrt(F.avg(F.col(sample) * F.col(sample))).alias("rms"))


def resample_pcm16(
    signal: DataFrame,
    stream: str = "stream_id",
    idx: str = "idx",
    sample: str = "sample",
    source_rate: int = 48_000,
    target_rate: int = lx.TARGET_RATE,
) -> DataFrame:
    """Bucket-mean resampling to 16-bit values: ``(stream, bucket, pcm)``.

    The bucket of a sample follows from its index by integer arithmetic, so one stream spreads over all tasks. Each
    bucket holds only ``source_rate / target_rate`` samples, which are averaged in index order.
    """
    if source_rate < target_rate:
        raise ValueError("the source rate must not be below the target rate")
    # floor(bucket * source / target) <= idx  <=>  bucket <= ((idx + 1) * target - 1) / source
    bucket = F.floor(((F.col(idx) + 1) * target_rate - 1) / F.lit(source_rate)).cast("long")
    sizes = signal.groupBy(stream).agg(F.count(F.lit(1)).alias("_n"))
    whole = F.floor(F.col("_n") * target_rate / source_rate)
    grouped = signal.withColumn("bucket", bucket).groupBy(stream, "bucket")
    means = grouped.agg(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(sample).alias("s")))).alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v["s"])
    mean = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total / F.size("x")))
    scaled = F.when(mean < 0, mean * lx.PCM_NEGATIVE).otherwise(mean * lx.PCM_POSITIVE)
    kept = means.join(sizes, stream).filter(F.col("bucket") < whole)
    return kept.select(stream, "bucket", scaled.cast(T.IntegerType()).alias("pcm"))
