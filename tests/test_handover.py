"""Captures into questions: each batch once, however often it runs."""

from datetime import timedelta

from gleaner.streaming import captures, handover
from tests.test_timed_captures import SCHEMA, START, WAIT_MS, made_events


def test_questions_once(spark, tmp_path):
    events = made_events(3, sessions=6, n=40)
    end = [(99, 1, 10_000, START + timedelta(days=3), "ready", None, False)]
    src, path, checkpoint = (str(tmp_path / n) for n in ("in", "questions", "cp"))
    for part in (events[: len(events) // 2], events[len(events) // 2 :], end):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 3).json(src)
    submitted = captures.stream_by_time(stream, "10 seconds", WAIT_MS)
    assert handover.hand_over(submitted, path, checkpoint, availableNow=True).awaitTermination(200)
    batch = captures.fold_by_time(spark.createDataFrame(events, SCHEMA), WAIT_MS)
    want = sorted(map(tuple, handover.questions_of(batch).collect()))
    got = handover.read_questions(spark, path)
    assert want and sorted(map(tuple, got.collect())) == want
    # The last batch again, as after a failure between its write and its commit; then another one.
    handover.write_batch(batch, 7, path)
    handover.write_batch(batch, 7, path)
    assert sorted(map(tuple, handover.read_questions(spark, path).distinct().collect())) == want
    assert handover.read_questions(spark, path).count() == 2 * len(want)


def test_late_and_empty(spark):
    rows = [(1, 1, "What is a plan? And the metric", "final"), (1, 2, "too late", "late"), (1, 3, "", "final"), (1, 4, None, "final")]
    df = spark.createDataFrame(rows, "session_id long, capture_id long, text string, reason string")
    got = handover.questions_of(df).collect()
    assert [(r["capture_id"], r["reason"]) for r in got] == [(1, "final")] and got[0]["query"]
