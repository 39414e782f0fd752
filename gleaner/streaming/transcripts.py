"""Recogniser messages to finished questions, as a batch job and as a stream with the same fold.

Rows: ``session_id, capture_id, seq, event_time, type, text, is_final``. Within a session a capture is stale once a newer
one was seen. Result rows are folded into the capture's text, over all its segments; after a stop the capture waits, and is
submitted once: on a final result, a closing event or a newer capture while it waits, or when the wait runs out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleaner import lexicons as lx
from gleaner.functions import text as tx
from gleaner.operators import ordered
from gleaner.streaming.merge import Transcript

SENTENCE = "struct<sentence:string,sentence_type:int,speaker_id:int>"
SPEAKER_MESSAGE = (
    f"struct<code:int,message:string,sentences:struct<sentence_list:array<{SENTENCE}>,sentence:string,sentence_type:int,"
    f"speaker_id:int>,speaker_sentences:array<{SENTENCE}>>"
)
RESULT_MESSAGE = "struct<result:struct<text:string,utterances:array<struct<text:string>>>>"
OUTPUT_SCHEMA = T.StructType(
    [
        T.StructField("session_id", T.LongType()),
        T.StructField("capture_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)
#: A session's stream state is dropped when nothing came for so long.
STATE_TTL_MS = 24 * 3_600_000
EVENT_COLUMNS = ("session_id", "capture_id", "seq", "type", "text", "is_final")


def flatten_sentences(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per sentence: from the sentence list, else the single sentence, else the speaker list."""
    carried = [c for c in messages.columns if c != raw]
    m = messages.select(*carried, F.from_json(raw, SPEAKER_MESSAGE).alias("m"))
    single = F.array(
        F.struct(
            F.col("m.sentences.sentence").alias("sentence"),
            F.col("m.sentences.sentence_type").alias("sentence_type"),
            F.col("m.sentences.speaker_id").alias("speaker_id"),
        )
    )
    has_single = tx.text_or_empty("m.sentences.sentence") != ""
    rows = F.coalesce(F.col("m.sentences.sentence_list"), F.when(has_single, single), F.col("m.speaker_sentences"))
    return m.select(*carried, F.posexplode(rows).alias("pos", "s")).select(*carried, "pos", "s.*")


def result_rows(messages: DataFrame, raw: str = "raw", is_final: Column | None = None) -> DataFrame:
    """One row per message with text: the full text, else the last utterance; blank and malformed ones are dropped."""
    carried = [c for c in messages.columns if c != raw]
    m = messages.withColumn("m", F.from_json(raw, RESULT_MESSAGE))
    full = tx.text_or_empty("m.result.text")
    last = F.try_element_at(F.col("m.result.utterances"), F.lit(-1))["text"]
    text = tx.trim(F.when(full != "", full).otherwise(F.coalesce(last, F.lit(""))))
    return m.select(
        *carried,
        text.alias("text"),
        (full != "").alias("is_cumulative"),
        (F.lit(False) if is_final is None else is_final).alias("final"),
    ).filter("text <> ''")


def gate_events(events: DataFrame, session: str = "session_id", order: str = "seq") -> DataFrame:
    """Non-blank result rows of captures that were not superseded when the row arrived."""
    seen = ordered.running_max(events, [session], order, "capture_id", "_current")
    live = seen.filter(F.col("capture_id") == F.col("_current")).drop("_current")
    return live.filter((F.col("type") == "result") & (tx.trim(tx.text_or_empty("text")) != ""))


class Capture:
    """State of one session: the current capture, its text, whether it waits for a final result, and until when.

    ``deadline`` is set where steps carry a time; without times the wait has no end of its own.
    """

    __slots__ = ("capture_id", "transcript", "waiting", "done", "deadline")

    def __init__(
        self,
        capture_id: int = -1,
        text: str | Transcript = "",
        waiting: bool = False,
        done: bool = False,
        deadline: int = -1,
    ):
        self.capture_id, self.waiting, self.done, self.deadline = capture_id, waiting, done, deadline
        self.transcript = text if isinstance(text, Transcript) else Transcript([text])

    @property
    def text(self) -> str:
        return self.transcript.text

    def submit(self, reason: str) -> tuple[int, str, str] | None:
        self.waiting = False
        if self.done or not self.text:
            return None
        self.done = True
        return self.capture_id, self.text, reason

    def expire(self, now: int) -> list[tuple[int, str, str]]:
        """The submission that was due before ``now``, if any."""
        if not self.waiting or not 0 <= self.deadline < now:
            return []
        row = self.submit("timeout")
        return [row] if row else []

    def step(
        self, capture_id: int, kind: str, text: str | None, is_final: bool, deadline: int = -1
    ) -> list[tuple[int, str, str]]:
        """Fold one event; ``deadline`` is the end of the wait that a stop would begin."""
        out = []
        if capture_id < self.capture_id:
            return out
        if capture_id > self.capture_id:
            if self.waiting:
                out.append(self.submit("superseded"))
            self.__init__(capture_id)
        if kind == "stop":
            if not self.waiting:
                self.waiting, self.deadline = not self.done, deadline
        elif kind in ("error", "closed"):
            if self.waiting:
                out.append(self.submit(kind))
            elif not self.done:
                self.transcript, self.done = Transcript(), True
        elif kind == "result" and text and text.strip() and not self.done:
            self.transcript.merge(text)
            if is_final and self.waiting:
                out.append(self.submit("final"))
        return [row for row in out if row]


def fold_captures(events: DataFrame) -> DataFrame:
    """Batch form: one row per submitted capture.

    Events of captures that a newer one had replaced are dropped first (a blocked running maximum); what is left depends
    on its own capture alone, so the fold is keyed by session and capture, and a long session is spread over many tasks. A
    capture's rows are sorted by Spark and stream through a state of one text.
    """
    partitions = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.select(*EVENT_COLUMNS)
    seen = ordered.running_max(rows, ["session_id"], "seq", "capture_id", "_current")
    newest = rows.groupBy("session_id").agg(F.max("capture_id").alias("_newest"))
    live = seen.filter(F.col("capture_id") == F.col("_current")).join(newest, "session_id")
    live = live.select(*EVENT_COLUMNS, (F.col("capture_id") < F.col("_newest")).alias("_replaced"))
    routed = live.repartition(partitions, "session_id", "capture_id")
    routed = routed.sortWithinPartitions("session_id", "capture_id", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, replaced = None, Capture(), False
        columns = [f.name for f in OUTPUT_SCHEMA.fields]

        def ended() -> list[tuple]:
            row = state.submit("superseded" if replaced else "timeout") if current and state.waiting else None
            return [(current[0], *row)] if row else []

        for frame in batches:
            out = []
            for sid, capture, _, kind, text, final, newer in frame.itertuples(index=False):
                if (sid, capture) != current:
                    out += ended()
                    current, state = (sid, capture), Capture()
                replaced = bool(newer)
                out.extend((sid, *row) for row in state.step(int(capture), kind, text, bool(final)))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(ended(), columns=columns)

    return routed.mapInPandas(run, OUTPUT_SCHEMA)


def fold_text(segments: DataFrame, key: Sequence[str], order: str, text: str, out: str = "text") -> DataFrame:
    """The transcript fold alone over any table of segments: ``(key, text)``, one row per key."""
    partitions = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = segments.select(*key, order, F.col(text).alias("_t")).repartition(partitions, *key)
    routed = routed.sortWithinPartitions(*key, order)
    schema = T.StructType([*[segments.schema[k] for k in key], T.StructField(out, T.StringType())])
    width = len(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, merged = None, Transcript()
        for frame in batches:
            rows = []
            for values in frame.itertuples(index=False):
                name = tuple(values[:width])
                if name != current:
                    if current is not None:
                        rows.append((*current, merged.text))
                    current, merged = name, Transcript()
                merged.merge(values[-1] or "")
            yield pd.DataFrame(rows, columns=schema.names)
        if current is not None:
            yield pd.DataFrame([(*current, merged.text)], columns=schema.names)

    return routed.mapInPandas(run, schema)


class CaptureProcessor(StatefulProcessor):
    """Stream form of the fold: state per session, and a processing-time timer for the wait after a stop."""

    def __init__(self, wait_ms: int = lx.FINAL_WAIT_MS):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        schema = "capture_id long, text string, waiting boolean, done boolean, deadline long"
        self.state = handle.getValueState("capture", schema, STATE_TTL_MS)

    def _load(self) -> Capture:
        return Capture(*self.state.get()) if self.state.exists() else Capture()

    def _save(self, c: Capture) -> None:
        self.state.update((c.capture_id, c.text, c.waiting, c.done, c.deadline))

    @staticmethod
    def _frame(session: int, rows: list) -> pd.DataFrame:
        return pd.DataFrame([(session, *r) for r in rows], columns=[f.name for f in OUTPUT_SCHEMA.fields])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        capture, out = self._load(), []
        waited, before = (capture.capture_id if capture.waiting else None), capture.deadline
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for row in frame.itertuples(index=False):
            out.extend(capture.step(int(row.capture_id), row.type, row.text, bool(row.is_final)))
        if waited is not None and not (capture.waiting and capture.capture_id == waited):
            self.handle.deleteTimer(before)
            capture.deadline = -1
        if capture.waiting and capture.capture_id != waited:
            capture.deadline = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
            self.handle.registerTimer(capture.deadline)
        self._save(capture)
        yield self._frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        capture, out = self._load(), []
        # Only the timer of the wait that is still on counts.
        due = expiredTimerInfo.getExpiryTimeInMs() == capture.deadline
        if due and capture.waiting and (row := capture.submit("timeout")):
            out.append(row)
            capture.deadline = -1
        self._save(capture)
        yield self._frame(key[0], out)

    def close(self) -> None:
        pass


def stream_captures(events: DataFrame, wait_ms: int = lx.FINAL_WAIT_MS) -> DataFrame:
    """Stream form: submitted captures as they finish. Needs the RocksDB state store provider."""
    keyed = events.select(*EVENT_COLUMNS).groupBy("session_id")
    return keyed.transformWithStateInPandas(
        statefulProcessor=CaptureProcessor(wait_ms),
        outputStructType=OUTPUT_SCHEMA,
        outputMode="Append",
        timeMode="processingTime",
    )
