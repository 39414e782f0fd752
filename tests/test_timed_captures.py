"""Event-time captures: a shuffled, delayed stream gives the batch result, late rows leave aside, state is freed."""

import random
from datetime import datetime, timedelta, timezone

from gleaner.streaming import captures

SCHEMA = "session_id long, capture_id long, seq long, event_time timestamp, type string, text string, is_final boolean"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)
WAIT_MS = 2_500


def made_events(seed: int, sessions: int = 12, n: int = 60):
    """Sessions of captures with segments, stops, errors and events of captures that were already replaced."""
    rng = random.Random(seed)
    out, seq = [], 0
    for session in range(sessions):
        ms, capture = rng.randint(0, 4000), 1
        for _ in range(n):
            ms += rng.choice([0, 100, 700, 1500, 3000])
            seq += 1
            kind = rng.choices(["result", "stop", "error", "closed", "ready"], [10, 3, 1, 1, 1])[0]
            text = " ".join(rng.choice(["what", "is", "a", "plan?", "你好", "项目"]) for _ in range(rng.randint(0, 4)))
            capture += rng.random() < 0.15
            own = capture - (rng.random() < 0.1)
            out.append((session, own, seq, START + timedelta(milliseconds=ms), kind, text, rng.random() < 0.4))
    return out


def run_stream(spark, tmp_path, name, frame, parts, schema=SCHEMA):
    """The rows of ``frame(stream)`` after all ``parts``, one micro-batch each."""
    src = tmp_path / f"{name}-in"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    query = (
        frame(stream).writeStream.outputMode("append").format("memory").queryName(name)
        .option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(240)
    return [tuple(r) for r in spark.table(name).collect()], tmp_path / f"{name}-cp"


def test_shuffled_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    events = made_events(1)
    arrival = sorted(events, key=lambda e: e[3] + timedelta(milliseconds=rng.randint(0, 9_000)))
    end = [(99, 1, 10_000, START + timedelta(days=3), "ready", None, False)]
    size = len(arrival) // 6
    parts = [arrival[i : i + size] for i in range(0, len(arrival), size)] + [end, end]
    want = sorted(tuple(r) for r in captures.fold_by_time(spark.createDataFrame(events, SCHEMA), WAIT_MS).collect())
    got, checkpoint = run_stream(spark, tmp_path, "timed", lambda s: captures.stream_by_time(s, "10 seconds", WAIT_MS), parts)
    assert sorted(r[:4] for r in got) == want
    assert {"final", "timeout", "superseded", "closed"} <= {r[3] for r in want}
    held = spark.read.format("statestore").option("path", str(checkpoint)).option("stateVarName", "head").load()
    assert [r["key"]["session_id"] for r in held.select("key").collect()] == [99]


def test_late_rows_leave_aside(spark, tmp_path):
    def at(seconds):
        return START + timedelta(seconds=seconds)

    first = [(1, 1, 1, at(0), "result", "what is", False), (1, 1, 2, at(1), "stop", None, False), (2, 1, 3, at(100), "ready", None, False)]
    second = [(1, 1, 4, at(2), "result", "too late", True), (2, 1, 5, at(200), "ready", None, False)]
    odd = [(None, 1, 6, at(200), "stop", None, False), (1, None, 7, at(200), "stop", None, False), (1, 1, 8, None, "stop", None, False)]
    got, _ = run_stream(spark, tmp_path, "late", lambda s: captures.stream_by_time(s, "10 seconds", WAIT_MS), [first, second, odd])
    assert sorted(got) == [(1, 1, "too late", "late", 4), (1, 1, "what is", "timeout", None)]


def test_batch_waits_in_event_time(spark):
    def at(ms):
        return START + timedelta(milliseconds=ms)

    rows = [
        (1, 1, 1, at(0), "result", "a plan", False),
        (1, 1, 2, at(100), "stop", None, False),
        (1, 1, 3, at(200), "stop", None, False),  # doesn't begin the wait again
        (1, 1, 4, at(100 + WAIT_MS), "result", "in time", True),
        (2, 1, 5, at(0), "result", "a plan", False),
        (2, 1, 6, at(100), "stop", None, False),
        (2, 1, 7, at(101 + WAIT_MS), "result", "too late", True),
        (3, 1, 8, at(0), "result", "first", False),
        (3, 1, 9, at(1), "stop", None, False),
        (3, 2, 10, at(1 + WAIT_MS), "result", "second", False),
        (4, 1, 11, at(0), "result", "first", False),
        (4, 1, 12, at(1), "stop", None, False),
        (4, 2, 13, at(2 + WAIT_MS), "result", "second", False),
    ]
    random.Random(2).shuffle(rows)
    got = sorted(tuple(r) for r in captures.fold_by_time(spark.createDataFrame(rows, SCHEMA), WAIT_MS).collect())
    assert got == [(1, 1, "a planin time", "final"), (2, 1, "a plan", "timeout"), (3, 1, "first", "superseded"), (4, 1, "first", "timeout")]
    assert captures.fold_by_time(spark.createDataFrame([], SCHEMA)).collect() == []
