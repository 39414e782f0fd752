"""Captures by event time: the transcript fold under shuffled and delayed arrival, as a batch job and as a stream.

Rows as in ``transcripts``, with ``event_time``. Events of a session count in the order of ``(event_time, seq)``, whenever
they arrive, and the wait after a stop ends ``wait_ms`` of event time later. The stream keeps events until the watermark
has passed them; what arrives behind the watermark leaves by a side output, with reason ``late``. Rows without event time,
capture or session are left out by both forms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleaner import lexicons as lx
from gleaner.operators import ordered
from gleaner.streaming.merge import Transcript
from gleaner.streaming.transcripts import EVENT_COLUMNS, OUTPUT_SCHEMA, Capture

#: A session's state goes when nothing came for so long, in event time.
IDLE_MS = 24 * 3_600_000
LATE = "late"
STREAM_SCHEMA = T.StructType([*OUTPUT_SCHEMA.fields, T.StructField("seq", T.LongType())])
_DAY_MS = 24 * 3_600_000
_EMITTED = Row(*STREAM_SCHEMA.names)


def _timed(events: DataFrame) -> DataFrame:
    usable = F.col("event_time").isNotNull() & F.col("capture_id").isNotNull() & F.col("session_id").isNotNull()
    return events.where(usable).select(*EVENT_COLUMNS, F.unix_millis(F.col("event_time").cast("timestamp")).alias("at"))


def fold_by_time(events: DataFrame, wait_ms: int = lx.FINAL_WAIT_MS) -> DataFrame:
    """Batch form: one row per submitted capture.

    Stale events are dropped by a blocked running maximum; what is left depends on its own capture and on the time at which
    the next one begins, so the fold is keyed by session and capture.
    """
    partitions = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _timed(events).withColumn("_order", F.struct("at", "seq"))
    day = F.floor(F.col("at") / _DAY_MS)
    seen = ordered.running_max(rows, ["session_id"], "_order", "capture_id", "_current", block=day)
    live = seen.filter(F.col("capture_id") == F.col("_current"))
    starts = live.groupBy("session_id", "capture_id").agg(F.min("at").alias("_start"))
    starts = starts.withColumn("_back", -F.col("capture_id"))
    after = ordered.previous_rows(starts, ["session_id"], "_back", F.col("_start"), 1, "_after")
    after = after.select("session_id", "capture_id", F.try_element_at("_after", F.lit(1)).alias("_next"))
    routed = live.select(*EVENT_COLUMNS, "at").join(after, ["session_id", "capture_id"])
    routed = routed.repartition(partitions, "session_id", "capture_id")
    routed = routed.sortWithinPartitions("session_id", "capture_id", "at", "seq")
    columns = [f.name for f in OUTPUT_SCHEMA.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, following = None, Capture(), None

        def ended() -> list[tuple]:
            if not state.waiting:
                return []
            replaced = following is not None and following <= state.deadline
            row = state.submit("superseded" if replaced else "timeout")
            return [(current[0], *row)] if row else []

        for frame in batches:
            out = []
            for sid, capture, _, kind, text, final, at, after_ in frame.itertuples(index=False):
                if (sid, capture) != current:
                    out += ended()
                    current, state = (sid, capture), Capture()
                following = None if pd.isna(after_) else int(after_)
                out += [(sid, *row) for row in state.expire(int(at))]
                out += [(sid, *row) for row in state.step(int(capture), kind, text, bool(final), int(at) + wait_ms)]
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(ended(), columns=columns)

    return routed.mapInPandas(run, OUTPUT_SCHEMA)


class TimedCaptureProcessor(StatefulProcessor):
    """State per session: events ahead of the watermark, the capture they lead to, and its text in pieces.

    One event-time timer stands for the earliest thing to come: an event to fold, the end of a wait, or the end of the
    session's state. Rows go through as rows, and a call asks the state store no more often than it must.
    """

    def __init__(self, wait_ms: int, idle_ms: int):
        self.wait_ms, self.idle_ms = wait_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        head = "capture_id long, waiting boolean, done boolean, deadline long, settled boolean, wide_mark int, n int, last long, timer long"
        self.head = handle.getValueState("head", head)
        self.pieces = handle.getListState("pieces", "piece string")
        self.pending = handle.getListState(
            "pending", "at long, seq long, capture_id long, type string, text string, is_final boolean"
        )

    def _load(self) -> tuple[Capture, int, int]:
        head = self.head.get()
        if head is None:
            return Capture(), -1, -1
        capture_id, waiting, done, deadline, settled, wide_mark, n, last, timer = head
        pieces = [p[0] for p in self.pieces.get()] if n else []
        return Capture(capture_id, Transcript(pieces, settled, wide_mark), waiting, done, deadline), last, timer

    @staticmethod
    def _head_of(c: Capture) -> tuple:
        t = c.transcript
        return c.capture_id, c.waiting, c.done, c.deadline, t.settled, t.wide_mark, len(t.pieces)

    def _save(self, c: Capture, before: list[str], last: int, timer: int) -> None:
        """New pieces are appended; the list is only written anew where an old piece changed."""
        pieces = c.transcript.pieces
        if pieces[: len(before)] == before:
            if pieces[len(before) :]:
                self.pieces.appendList([(p,) for p in pieces[len(before) :]])
        else:
            if pieces:
                self.pieces.put([(p,) for p in pieces])
            else:
                self.pieces.clear()
        self.head.update((*self._head_of(c), last, timer))

    def _move_timer(self, old: int, new: int) -> None:
        if old != new:
            if old >= 0:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        late, ahead = [], []
        for r in rows:
            if r.at <= watermark:
                late.append(_EMITTED(key[0], r.capture_id, r.text, LATE, r.seq))
            else:
                ahead.append((r.at, r.seq, r.capture_id, r.type, r.text, bool(r.is_final)))
        if ahead:
            self.pending.appendList(ahead)
            *state, last, timer = self.head.get() or (*self._head_of(Capture()), -1, -1)
            first, newest = min(a[0] for a in ahead), max(a[0] for a in ahead)
            earlier = timer < 0 or first < timer
            if earlier:
                self._move_timer(timer, first)
                timer = first
            if earlier or newest > last:
                self.head.update((*state, max(last, newest), timer))
        return iter(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        capture, last, timer = self._load()
        before, out = list(capture.transcript.pieces), []
        waiting_rows = sorted(self.pending.get(), key=lambda r: (r[0], r[1]))
        ahead = [r for r in waiting_rows if r[0] > watermark]
        for at, _, capture_id, kind, text, final in waiting_rows[: len(waiting_rows) - len(ahead)]:
            out += capture.expire(at)
            out += capture.step(capture_id, kind, text, final, at + self.wait_ms)
        out += capture.expire(watermark + 1)
        if ahead:
            self.pending.put([tuple(r) for r in ahead])
        elif waiting_rows:
            self.pending.clear()
        due = [r[0] for r in ahead[:1]] + ([capture.deadline] if capture.waiting else [])
        due.append(last + self.idle_ms)
        if min(due) <= watermark:  # only the end of the state is due
            for state in (self.head, self.pieces, self.pending):
                state.clear()
        else:
            following = min(due)
            if following != timer or timer == expiredTimerInfo.getExpiryTimeInMs():
                self.handle.registerTimer(following)
            self._save(capture, before, last, following)
        return iter([_EMITTED(key[0], *row, None) for row in out])

    def close(self) -> None:
        pass


def stream_by_time(
    events: DataFrame,
    delay: str = "10 seconds",
    wait_ms: int = lx.FINAL_WAIT_MS,
    idle_ms: int = IDLE_MS,
) -> DataFrame:
    """Stream form: ``(session_id, capture_id, text, reason, seq)``, submitted captures as the watermark passes their end,
    and late events with reason ``late`` and their ``seq``.

    ``delay`` is how far an event may fall behind the newest one. Within it the submitted captures are those of
    ``fold_by_time``, if a session doesn't come back to an old capture after ``idle_ms``. Needs the RocksDB state store
    provider. A session is one key; its buffered events are what the delay spans.
    """
    marked = events.withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", delay)
    return _timed(marked).groupBy("session_id").transformWithState(
        statefulProcessor=TimedCaptureProcessor(wait_ms, idle_ms),
        outputStructType=STREAM_SCHEMA,
        outputMode="Append",
        timeMode="EventTime",
    )
