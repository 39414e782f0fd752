"""Queries over sessions, signals, transcripts and delta streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import ordered, sessions
from gleaner.plans import base, transcript_sql
from gleaner.plans.registry import query, table
from gleaner.streaming import answers, captures, deltas, health, replay, transcripts


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_SHORT, _LONG = 2 * 3600_000, 7 * 3600_000


@query(
    "silence_sessions",
    base.with_ctes(
        f"""e AS (SELECT user_id, ts, value, ts + CASE WHEN event_type = 'purchase' THEN INTERVAL {_SHORT} MILLISECONDS
    ELSE INTERVAL {_LONG} MILLISECONDS END AS fin FROM events),
m AS (SELECT *, max(fin) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open_until FROM e),
g AS (SELECT *, sum(CASE WHEN open_until IS NULL OR ts >= open_until THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM m)""",
        """SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(fin)) AS committed, count(*) AS n, round(sum(value), 2) AS total
FROM g GROUP BY user_id, s""",
    ),
)
def silence_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions.silence_sessions(
        events(spark, sf_dir),
        ["user_id"],
        "ts",
        F.col("event_type") == "purchase",
        _SHORT,
        _LONG,
        [F.round(F.sum("value"), 2).alias("total")],
        block=F.date_trunc("day", "ts"),
    )
    return s.select(
        "user_id", F.unix_micros("started").alias("started"), F.unix_micros("committed").alias("committed"), "n", "total"
    )


@query(
    "voice_sessions",
    base.with_ctes(
        """e AS (SELECT user_id, ts FROM events WHERE value > 30),
m AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM e),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 5 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM m)""",
        """SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts) + INTERVAL 5 HOURS) AS submitted, count(*) AS n FROM g
GROUP BY user_id, s""",
    ),
)
def voice_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions.voice_sessions(events(spark, sf_dir), ["user_id"], "ts", F.col("value") > 30, 5 * 3600_000, block=F.date_trunc("day", "ts"))
    return s.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("submitted").alias("submitted"), "n")


@query(
    "frame_gaps",
    """SELECT event_id, gap_ms, coalesce(gap_ms > 3600000, false) AS stale FROM (
  SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) // 1000 AS gap_ms FROM events)""",
)
def frame_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = sessions.frame_gaps(events(spark, sf_dir), ["user_id"], "ts", 3600_000)
    return gaps.select("event_id", "gap_ms", "stale")


@query(
    "throttled_rebuilds",
    """
WITH RECURSIVE stale AS (SELECT user_id, ts, gap_ms FROM (
  SELECT user_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) // 1000 AS gap_ms FROM events)
  WHERE gap_ms > 3600000),
kept AS (SELECT user_id, min(ts) AS ts FROM stale GROUP BY user_id
  UNION ALL SELECT k.user_id, min(s.ts) FROM kept k JOIN stale s ON s.user_id = k.user_id AND s.ts > k.ts + INTERVAL 24 HOURS
  GROUP BY k.user_id, k.ts)
SELECT user_id, epoch_us(ts) AS at, gap_ms FROM stale JOIN kept USING (user_id, ts)""",
)
def throttled_rebuilds(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = sessions.frame_gaps(events(spark, sf_dir), ["user_id"], "ts", 3600_000)
    stale = gaps.filter("stale").select("user_id", "ts", "gap_ms")
    kept = sessions.throttle(stale, ["user_id"], "ts", 24 * 3600_000)
    return kept.select("user_id", F.unix_micros("ts").alias("at"), "gap_ms")


_GAP, _EVERY = 12 * 3600_000, 20 * 3600_000
#: Alarms of each gap, one after the other; purchases end the listening.
_MISSED_SQL = f"""
WITH f AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, bool_or(event_type <> 'purchase') AS listening FROM events GROUP BY ALL),
g AS (SELECT user_id, ms, coalesce(lead(ms) OVER (PARTITION BY user_id ORDER BY ms), ms + {_EVERY * 4}) AS until, listening FROM f),
l AS (SELECT user_id, list({{'ms': ms, 'until': until, 'raised': NULL::BIGINT, 'alarms': []::BIGINT[]}} ORDER BY ms) AS gaps
  FROM g WHERE listening AND until - ms > {_GAP} + 1 GROUP BY user_id),
r AS (SELECT user_id, list_reduce(list_prepend({{'ms': 0::BIGINT, 'until': 0::BIGINT, 'raised': NULL::BIGINT, 'alarms': []::BIGINT[]}}, gaps),
  lambda a, b: list_transform([range(greatest(b.ms + {_GAP} + 1, coalesce(a.raised + {_EVERY} + 1, 0)), b.until, {_EVERY} + 1)],
    lambda n: {{'ms': 0::BIGINT, 'until': 0::BIGINT, 'raised': coalesce(n[-1], a.raised), 'alarms': list_concat(a.alarms, n)}})[1]) AS s FROM l)
SELECT user_id, unnest(s.alarms) AS "at" FROM r"""


@query("missed_frames", _MISSED_SQL)
def missed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms while frames stay out: after twelve hours, then every twenty."""
    listening = F.col("event_type") != "purchase"
    return health.missed_frames(events(spark, sf_dir), ["user_id"], "ts", listening, _GAP, _EVERY, _EVERY * 4)


@query("stream_missed_frames", _MISSED_SQL)
def stream_missed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream, whose frames arrive up to three hours late; no frame needs to follow for an alarm."""
    e = events(spark, sf_dir).select("user_id", "ts", "event_type", "event_id")
    delay = F.pmod(F.xxhash64("event_id"), F.lit(3 * 3600_000))
    parts = replay.arriving(e, F.unix_millis("ts") + delay, 6)
    last = e.agg(F.max("ts").alias("ts")).where("ts IS NOT NULL").select(
        F.lit(-1).cast(e.schema["user_id"].dataType).alias("user_id"),
        (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"),
        F.lit("purchase").alias("event_type"),
        F.lit(-1).cast(e.schema["event_id"].dataType).alias("event_id"),
    )
    listening = F.col("event_type") != "purchase"

    def stream(s: DataFrame) -> DataFrame:
        return health.stream_missed_frames(s, "user_id", "ts", "3 hours", listening, _GAP, _EVERY, _EVERY * 4)

    return replay.replay([*parts, last], stream, replay.width(spark))


@query(
    "voice_activity",
    """SELECT vec_id, round(rms, 6) AS rms, rms > 0.124 AS voiced FROM (
  SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)) AS rms FROM embeddings)""",
)
def voice_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rms = sessions.frame_rms("embedding")
    v = table(spark, sf_dir, "embeddings").select("vec_id", rms.alias("rms"))
    return v.select("vec_id", F.round("rms", 6).alias("rms"), sessions.is_voiced(F.col("rms"), 0.124).alias("voiced"))


@query(
    "voice_activity_grouped",
    "SELECT user_id, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY user_id",
)
def voice_activity_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sessions.grouped_rms(events(spark, sf_dir), ["user_id"], "value")
    return r.select("user_id", F.round("rms", 6).alias("rms"))


@query(
    "resample_signal",
    base.with_ctes(
        """sig AS (SELECT 0 AS stream_id, event_id AS idx, value / 40 - 1 AS sample FROM events),
n AS (SELECT stream_id, floor(count(*) * 16000 / 44100) AS whole FROM sig GROUP BY 1),
b AS (SELECT stream_id, floor(((idx + 1) * 16000 - 1) / 44100)::BIGINT AS bucket, list(sample ORDER BY idx) AS x FROM sig GROUP BY 1, 2),
m AS (SELECT stream_id, bucket, greatest(-1.0, least(1.0, list_reduce(x, lambda a, v: a + v) / len(x))) AS mean
      FROM b JOIN n USING (stream_id) WHERE bucket < whole)""",
        "SELECT stream_id, bucket, trunc(CASE WHEN mean < 0 THEN mean * 32768 ELSE mean * 32767 END)::BIGINT AS pcm FROM m",
    ),
)
def resample_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = events(spark, sf_dir).select(
        F.lit(0).alias("stream_id"), F.col("event_id").alias("idx"), (F.col("value") / 40 - 1).alias("sample")
    )
    pcm = sessions.resample_pcm16(signal, source_rate=44_100)
    return pcm.select("stream_id", "bucket", F.col("pcm").cast("long").alias("pcm"))


@query(
    "latest_requests",
    """SELECT conv_id, turn, role FROM (SELECT *, CASE role WHEN 'user' THEN turn ELSE turn - 1 END AS request_id FROM conversations)
QUALIFY request_id = max(request_id) OVER (PARTITION BY conv_id)""",
)
def latest_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = F.when(F.col("role") == "user", F.col("turn")).otherwise(F.col("turn") - 1)
    c = table(spark, sf_dir, "conversations").withColumn("request_id", request)
    return ordered.keep_latest(c, ["conv_id"], "request_id").select("conv_id", "turn", "role")


# -- recogniser messages and transcripts --------------------------------------------------------------------------------


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as recogniser messages in the three shapes, chosen by event type."""
    k = F.get_json_object("props", "$.k").cast("int")
    one = F.struct(F.col("event_type").alias("sentence"), (k % 2).alias("sentence_type"), k.alias("speaker_id"))
    raw = (
        F.when(F.col("event_type") == "click", F.to_json(F.struct(F.struct(F.array(one, one).alias("sentence_list")).alias("sentences"))))
        .when(F.col("event_type") == "view", F.to_json(F.struct(one.alias("sentences"))))
        .when(F.col("event_type") == "error", F.lit("{broken"))
        .otherwise(F.to_json(F.struct(F.array(one).alias("speaker_sentences"))))
    )
    return events(spark, sf_dir).select("event_id", raw.alias("raw"))


@query(
    "flatten_sentences",
    """SELECT event_id, pos, event_type AS sentence, k % 2 AS sentence_type, k AS speaker_id FROM (
  SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, unnest(CASE WHEN event_type = 'click' THEN [0, 1] ELSE [0] END) AS pos
  FROM events WHERE event_type <> 'error')""",
)
def flatten_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = transcripts.flatten_sentences(_messages(spark, sf_dir))
    return s.select(
        "event_id",
        F.col("pos").cast("long").alias("pos"),
        "sentence",
        F.col("sentence_type").cast("long").alias("sentence_type"),
        F.col("speaker_id").cast("long").alias("speaker_id"),
    )


@query(
    "result_rows",
    """SELECT event_id, event_type AS text, event_type = 'click' AS is_cumulative FROM events WHERE event_type IN ('click', 'view')""",
)
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.struct(F.concat(F.lit(" "), "event_type").alias("text"))
    raw = (
        F.when(F.col("event_type") == "click", F.to_json(F.struct(said.alias("result"))))
        .when(
            F.col("event_type") == "view",
            F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("x").alias("text")), said).alias("utterances")).alias("result"))),
        )
        .otherwise('{"result": {"text": " "}}')
    )
    m = events(spark, sf_dir).select("event_id", raw.alias("raw"))
    return transcripts.result_rows(m).select("event_id", "text", "is_cumulative")


def _capture_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as sessions; the capture number follows the day, pushed back for some rows so that stale ones occur."""
    late = F.when(F.col("value") > 60, 1).otherwise(0)
    day = F.datediff(F.col("ts"), F.lit("2024-01-01")).cast("long")
    kind = (
        F.when(F.col("event_type") == "signup", "stop")
        .when(F.col("event_type") == "error", "closed")
        .otherwise("result")
    )
    return events(spark, sf_dir).select(
        F.col("user_id").alias("session_id"),
        (day - late).alias("capture_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("event_time"),
        kind.alias("type"),
        F.concat_ws(" ", "event_type", F.col("value").cast("string")).alias("text"),
        (F.col("event_type") == "purchase").alias("is_final"),
    )


@query(
    "gate_events",
    """
WITH e AS (SELECT event_id, user_id, event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) - CASE WHEN value > 60 THEN 1 ELSE 0 END AS capture_id FROM events)
SELECT event_id AS seq, user_id AS session_id, capture_id FROM (
  SELECT *, max(capture_id) OVER (PARTITION BY user_id ORDER BY event_id) AS cur FROM e)
WHERE capture_id = cur AND event_type NOT IN ('signup', 'error')""",
)
def gate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.gate_events(_capture_events(spark, sf_dir)).select("seq", "session_id", "capture_id")


#: The capture's state folded over its live events: waits after a stop, ends once.
_OUTCOME_SQL = """
WITH e AS (SELECT event_id, user_id, event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) - CASE WHEN value > 60 THEN 1 ELSE 0 END AS capture_id FROM events),
live AS (SELECT * FROM (SELECT *, max(capture_id) OVER (PARTITION BY user_id ORDER BY event_id) AS cur,
           max(capture_id) OVER (PARTITION BY user_id) AS newest FROM e) WHERE capture_id = cur),
steps AS (SELECT user_id, capture_id, capture_id < newest AS replaced, list({'kind': CASE event_type WHEN 'signup' THEN 'stop'
    WHEN 'error' THEN 'closed' ELSE 'result' END, 'fin': event_type = 'purchase', 'waiting': false, 'done': false, 'said': false,
    'reason': ''} ORDER BY event_id) AS l FROM live GROUP BY ALL),
ended AS (SELECT user_id, capture_id, replaced, list_reduce(list_prepend({'kind': '', 'fin': false, 'waiting': false, 'done': false,
    'said': false, 'reason': ''}, l), lambda a, b: {'kind': '', 'fin': false,
  'waiting': CASE WHEN b.kind = 'stop' THEN NOT a.done WHEN b.kind = 'closed' THEN false ELSE a.waiting AND NOT b.fin END,
  'done': a.done OR (b.kind = 'closed' AND (NOT a.waiting OR a.said)) OR (b.kind = 'result' AND b.fin AND a.waiting),
  'said': a.said OR b.kind = 'result',
  'reason': CASE WHEN a.done THEN a.reason WHEN b.kind = 'closed' AND a.waiting AND a.said THEN 'closed'
    WHEN b.kind = 'result' AND b.fin AND a.waiting THEN 'final' ELSE a.reason END}) AS s FROM steps)
SELECT user_id AS session_id, capture_id, reason FROM (
  SELECT *, CASE WHEN s.reason <> '' THEN s.reason WHEN s.waiting AND s.said AND NOT s.done THEN
    CASE WHEN replaced THEN 'superseded' ELSE 'timeout' END END AS reason FROM ended) WHERE reason IS NOT NULL"""


@query("capture_outcomes", _OUTCOME_SQL)
def capture_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which captures are submitted, and why."""
    return transcripts.fold_captures(_capture_events(spark, sf_dir)).select("session_id", "capture_id", "reason")


#: The same with the text, folded while the capture is open. With times, a wait ends so long after its stop.
def _fold_sql(wait_ms: int | None = None) -> str:
    timed = wait_ms is not None
    order = "ts, event_id" if timed else "event_id"
    start = "{'kind': '', 'fin': false, 'at': 0::BIGINT, 'x': '', 'waiting': false, 'done': false, 'until': 0::BIGINT, 't': '', 'reason': ''}"
    row = """{'kind': CASE event_type WHEN 'signup' THEN 'stop' WHEN 'error' THEN 'closed' ELSE 'result' END,
    'fin': event_type = 'purchase', 'at': epoch_us(ts) // 1000, 'x': event_type || ' ' || value, 'waiting': false, 'done': false,
    'until': 0::BIGINT, 't': '', 'reason': ''}"""
    # A wait that ended before the event, then the event itself.
    over = "(e.waiting AND e.until < b.at)" if timed else "false"
    expired = f"""{{'waiting': e.waiting AND NOT {over}, 'done': e.done OR ({over} AND e.t <> ''), 'until': e.until, 't': e.t,
    'reason': CASE WHEN {over} AND e.t <> '' THEN 'timeout' ELSE e.reason END}}"""
    said = "b.kind = 'result' AND NOT a.done"
    step = f"""{{'kind': '', 'fin': false, 'at': 0::BIGINT, 'x': '',
    'waiting': CASE WHEN b.kind = 'stop' THEN NOT a.done WHEN b.kind = 'closed' THEN false ELSE a.waiting AND NOT b.fin END,
    'done': a.done OR (b.kind = 'closed' AND (NOT a.waiting OR a.t <> '')) OR (b.kind = 'result' AND b.fin AND a.waiting),
    'until': CASE WHEN b.kind = 'stop' AND NOT a.waiting THEN b.at + {wait_ms or 0} ELSE a.until END,
    't': CASE WHEN {said} THEN {transcript_sql.merge("a.t", "b.x")} WHEN b.kind = 'closed' AND NOT a.waiting AND NOT a.done THEN '' ELSE a.t END,
    'reason': CASE WHEN a.done THEN a.reason WHEN b.kind = 'closed' AND a.waiting AND a.t <> '' THEN 'closed'
      WHEN b.kind = 'result' AND b.fin AND a.waiting THEN 'final' ELSE a.reason END}}"""
    replaced = "coalesce(following <= s.until, false)" if timed else "following IS NOT NULL"
    return f"""
WITH e AS (SELECT event_id, user_id, event_type, ts, value, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) - CASE WHEN value > 60 THEN 1 ELSE 0 END AS capture_id FROM events),
live AS (SELECT * FROM (SELECT *, max(capture_id) OVER (PARTITION BY user_id ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS cur FROM e) WHERE capture_id = cur),
starts AS (SELECT user_id, capture_id, lead(min(epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY capture_id) AS following
  FROM live GROUP BY user_id, capture_id),
steps AS (SELECT user_id, capture_id, list({row} ORDER BY {order}) AS l FROM live GROUP BY ALL),
ended AS (SELECT user_id, capture_id, following, list_reduce(list_prepend({start}, l),
  lambda e, b: {transcript_sql.let("a", expired, step)}) AS s FROM steps JOIN starts USING (user_id, capture_id))
SELECT user_id AS session_id, capture_id, text, reason FROM (
  SELECT *, s.t AS text, CASE WHEN s.reason <> '' THEN s.reason WHEN s.waiting AND s.t <> '' AND NOT s.done THEN
    CASE WHEN {replaced} THEN 'superseded' ELSE 'timeout' END END AS reason FROM ended) WHERE reason IS NOT NULL"""


@query("fold_captures", _fold_sql())
def fold_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.fold_captures(_capture_events(spark, sf_dir))


_WAIT = 6 * 3600_000


@query("timed_captures", _fold_sql(_WAIT))
def timed_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures by event time: a wait ends six hours after its stop."""
    return captures.fold_by_time(_capture_events(spark, sf_dir), _WAIT)


@query("stream_timed_captures", _fold_sql(_WAIT))
def stream_timed_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream, whose events arrive up to three hours late, in any order, in eight parts."""
    e = _capture_events(spark, sf_dir).withColumn("ts", F.unix_millis("event_time"))
    delay = F.pmod(F.xxhash64("seq"), F.lit(3 * 3600_000))
    parts = replay.arriving(e, F.col("ts") + delay, 8)
    # An event far ahead lets the watermark pass all others.
    last = e.agg(F.max("event_time").alias("event_time")).where("event_time IS NOT NULL").select(
        F.lit(-1).cast(e.schema["session_id"].dataType).alias("session_id"),
        F.lit(0).cast("long").alias("capture_id"),
        F.lit(-1).cast(e.schema["seq"].dataType).alias("seq"),
        (F.col("event_time") + F.expr("INTERVAL 30 DAYS")).alias("event_time"),
        F.lit("ready").alias("type"),
        F.lit(None).cast("string").alias("text"),
        F.lit(False).alias("is_final"),
    )
    parts = [p.select(*last.columns) for p in parts] + [last]
    made = replay.replay(parts, lambda s: captures.stream_by_time(s, "3 hours", _WAIT, 60 * captures.IDLE_MS), replay.width(spark))
    return made.select("session_id", "capture_id", "text", "reason")


@query(
    "fold_transcripts",
    f"""SELECT conv_id, {transcript_sql.fold("l")} AS text FROM (
  SELECT conv_id, list(coalesce(text, '') ORDER BY turn) AS l FROM conversations GROUP BY conv_id)""",
)
def fold_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation folded as transcript segments."""
    c = table(spark, sf_dir, "conversations")
    return transcripts.fold_text(c, ["conv_id"], "turn", "text")


# -- deltas -------------------------------------------------------------------------------------------------------------


def _delta_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as delta frames, alternating between the two payload shapes, each frame cut into two chunks."""
    c = table(spark, sf_dir, "conversations")
    plain = F.to_json(F.struct(F.col("text").alias("delta")))
    choice = F.to_json(
        F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"))
    )
    doc = F.when(F.col("role") == "user", plain).otherwise(choice)
    frame = F.concat(F.lit("data: "), doc, F.lit("\n\ndata: {bad\n\ndata: [DONE]\n\n"))
    cut = F.floor(F.length("frame") / 2).cast("int")
    halves = F.array(F.substring("frame", F.lit(1), cut), F.substring("frame", cut + 1, F.length("frame")))
    framed = c.select("conv_id", "turn", frame.alias("frame"))
    return framed.select(
        F.col("conv_id").alias("request_id"), "turn", F.posexplode(halves).alias("half", "chunk")
    ).select("request_id", (F.col("turn") * 2 + F.col("half")).alias("seq"), "chunk")


@query(
    "extract_deltas",
    "SELECT conv_id, turn, text AS delta FROM conversations",
)
def extract_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    doc = F.to_json(F.struct(F.col("text").alias("delta")))
    payload = F.concat(F.lit("event: x\ndata: "), doc, F.lit('\ndata: {"delta": 5}\ndata: nonsense\ndata: [DONE]\n'))
    rows = deltas.extract_deltas(c.select("conv_id", "turn", payload.alias("payload")))
    return rows.select("conv_id", "turn", "delta")


@query(
    "stream_answers",
    """SELECT conv_id AS request_id, string_agg(text, '' ORDER BY turn) AS answer, 'ready' AS status FROM conversations GROUP BY 1""",
)
def stream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminal rows of the answer stream, whose chunks arrive in four parts."""
    chunks = _delta_chunks(spark, sf_dir)
    last = chunks.groupBy("request_id").agg(F.max("seq").alias("_last"))
    chunks = chunks.join(last, "request_id").withColumn("is_last", F.col("seq") == F.col("_last")).drop("_last")
    made = replay.replay(replay.arriving(chunks, F.col("seq"), 4), lambda s: answers.stream_answers(s, 3_600_000), replay.width(spark), timers=True)
    return made.where("status <> 'delta'").select("request_id", F.col("text").alias("answer"), "status")


@query(
    "stream_latest_requests",
    """SELECT conv_id, turn, role FROM (SELECT *, CASE role WHEN 'user' THEN turn ELSE turn - 1 END AS request_id FROM conversations)
QUALIFY request_id = max(request_id) OVER (PARTITION BY conv_id)""",
)
def stream_latest_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a stream in shuffled arrival; a turn's time is its number in minutes."""
    request = F.when(F.col("role") == "user", F.col("turn")).otherwise(F.col("turn") - 1).cast("long")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", request.alias("request_id"))
    c = c.withColumn("ts", F.timestamp_seconds(F.col("turn") * 60))
    parts = replay.arriving(c, F.pmod(F.xxhash64("conv_id", "turn"), F.lit(1000)), 4)
    last = c.agg(F.max("ts").alias("ts")).where("ts IS NOT NULL").select(
        F.lit(-1).cast(c.schema["conv_id"].dataType).alias("conv_id"),
        F.lit(-1).cast(c.schema["turn"].dataType).alias("turn"),
        F.lit("end").alias("role"),
        F.lit(0).cast("long").alias("request_id"),
        (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"),
    )

    def stream(s: DataFrame) -> DataFrame:
        return answers.stream_latest_requests(s, "conv_id", "request_id", "ts", "1 day", 3_600_000)

    return replay.replay([*parts, last], stream, replay.width(spark)).select("conv_id", "turn", "role")


@query(
    "assemble_answers",
    """SELECT conv_id AS request_id, string_agg(text, '' ORDER BY turn) AS answer, 'ready' AS status FROM conversations GROUP BY 1""",
)
def assemble_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltas.assemble_answers(_delta_chunks(spark, sf_dir))
