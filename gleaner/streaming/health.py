"""Missing frames: an alarm while frames stay out, not only when the next one comes.

Frames of a key are expected at least every ``gap_ms``. While it listens and none came for longer, an alarm is raised, and
again whenever more than ``every_ms`` passed since the last alarm; a frame ends the alarm, and a frame with ``listening``
false ends the listening until the next one. All times are event time in whole milliseconds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner import lexicons as lx
from gleaner.operators import ordered
from gleaner.streaming.ordered_state import OrderedProcessor

_DAY_MS = 24 * 3_600_000


def alarms_between(last: int, until: int, raised: int | None, gap_ms: int, every_ms: int) -> range:
    """Times of the alarms after the frame at ``last`` and before ``until``."""
    start = last + gap_ms + 1
    if raised is not None:
        start = max(start, raised + every_ms + 1)
    return range(start, until, every_ms + 1)


def missed_frames(
    frames: DataFrame,
    key: Sequence[str],
    ts: str,
    listening: Column | None = None,
    gap_ms: int = lx.FRAME_GAP_MS,
    every_ms: int = lx.RECOVERY_MS,
    idle_ms: int = _DAY_MS,
) -> DataFrame:
    """Batch form: ``(key, at)``, the alarms in milliseconds. After its last frame a key raises alarms for ``idle_ms``, if it
    listens. Rows without time are left out; frames of one time count as listening if any of them does.

    Only gaps that raise alarms are folded. A gap whose first alarm is too late to be held back by the one before it begins
    a run; runs, not keys, are dealt to tasks. The gap before a frame comes from a look back that is cut into days.
    """
    spark_partitions = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    on = F.lit(True) if listening is None else F.coalesce(listening, F.lit(False))
    at = F.unix_millis(F.col(ts).cast("timestamp")).alias("at")
    rows = frames.where(F.col(ts).isNotNull()).select(*key, at, on.alias("on")).groupBy(*key, "at").agg(F.max("on").alias("on"))
    day = F.floor(F.col("at") / _DAY_MS)
    back = rows.withColumn("_back", -F.col("at"))
    gaps = ordered.previous_rows(back, list(key), "_back", F.col("at"), 1, "_next", block=day * -1)
    until = F.coalesce(F.try_element_at("_next", F.lit(1)), F.col("at") + idle_ms).alias("until")
    gaps = gaps.where("on").select(*key, "at", until).where(F.col("until") - F.col("at") > gap_ms + 1)
    before = ordered.previous_rows(gaps, list(key), "at", F.col("until"), 1, "_before", block=day)
    earlier = F.try_element_at("_before", F.lit(1))
    opens = F.when(earlier.isNull() | (F.col("at") + gap_ms >= earlier + every_ms), F.col("at"))
    runs = ordered.running_max(before.withColumn("_open", opens).drop("_before"), list(key), "at", "_open", "_run", block=day)
    routed = runs.select(*key, "_run", "at", "until").repartition(spark_partitions, *key, "_run")
    routed = routed.sortWithinPartitions(*key, "_run", "at")
    schema = T.StructType([*[frames.schema[k] for k in key], T.StructField("at", T.LongType())])
    width = len(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, raised = None, None
        for frame in batches:
            out = []
            for values in frame.itertuples(index=False):
                name = tuple(values[: width + 1])
                if name != current:
                    current, raised = name, None
                for alarm in alarms_between(int(values[-2]), int(values[-1]), raised, gap_ms, every_ms):
                    out.append((*values[:width], alarm))
                    raised = alarm
            yield pd.DataFrame(out, columns=schema.names)

    return routed.mapInPandas(run, schema)


class AlarmProcessor(OrderedProcessor):
    """State per key: the last frame, whether it listens, and the last alarm (-1: none)."""

    row_schema = "listening boolean"
    state_schema = "frame long, listening boolean, raised long"

    def __init__(self, output: T.StructType, gap_ms: int, every_ms: int, idle_ms: int):
        super().__init__(idle_ms)
        self.output, self.gap_ms, self.every_ms = output, gap_ms, every_ms

    def first(self) -> tuple:
        return -1, False, -1

    def _alarms(self, state: tuple, until: int) -> range:
        frame, listening, raised = state
        if not listening:
            return range(0)
        return alarms_between(frame, until, raised if raised >= 0 else None, self.gap_ms, self.every_ms)

    def advance(self, state: tuple, now: int, out: list) -> tuple:
        for alarm in self._alarms(state, now):
            out.append((alarm,))
            state = (state[0], state[1], alarm)
        return state

    def due(self, state: tuple) -> int | None:
        upcoming = self._alarms(state, 1 << 62)
        return upcoming[0] if upcoming else None

    def step(self, state: tuple, row: tuple, out: list) -> tuple:
        at, listening = row
        same = at == state[0]
        return at, bool(listening) or (same and state[1]), state[2]


def stream_missed_frames(
    frames: DataFrame,
    key: str,
    ts: str,
    delay: str,
    listening: Column | None = None,
    gap_ms: int = lx.FRAME_GAP_MS,
    every_ms: int = lx.RECOVERY_MS,
    idle_ms: int = _DAY_MS,
) -> DataFrame:
    """Stream form: an alarm leaves when the watermark passes its time, whether or not another frame ever comes. For
    frames no later than ``delay`` the alarms are those of ``missed_frames``. Needs the RocksDB state store provider."""
    on = F.lit(True) if listening is None else F.coalesce(listening, F.lit(False))
    marked = frames.withColumn("_time", F.col(ts).cast("timestamp")).withWatermark("_time", delay)
    rows = marked.where("_time IS NOT NULL").select(key, F.unix_millis("_time").alias("at"), on.alias("listening"))
    output = T.StructType([frames.schema[key], T.StructField("at", T.LongType())])
    return rows.groupBy(key).transformWithState(
        statefulProcessor=AlarmProcessor(output, gap_ms, every_ms, idle_ms),
        outputStructType=output,
        outputMode="Append",
        timeMode="EventTime",
    )
