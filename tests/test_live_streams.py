"""Alarms for missing frames, answers with an end, newest requests: each stream against its batch form."""

import random
import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from gleaner.operators import ordered
from gleaner.streaming import answers, deltas, health
from tests.test_timed_captures import run_stream

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
FRAME = "k long, ts timestamp, listening boolean"


def at(ms):
    return START + timedelta(milliseconds=ms)


BASE = int(START.timestamp() * 1000)


def plain_alarms(frames, idle):
    """The clock read every millisecond, from the first frame on."""
    out = []
    for k in {f[0] for f in frames}:
        own = {}
        for f in frames:
            if f[0] == k:
                ms = int(f[1].timestamp() * 1000)
                own[ms] = own.get(ms, False) or bool(f[2])
        last, raised, on = None, None, False
        for now in range(min(own), max(own) + idle):
            if now in own:
                last, on = now, own[now]
            elif on and now - last > 1600 and (raised is None or now - raised > 3000):
                out.append((k, now))
                raised = now
    return sorted(out)


def some_frames(seed):
    rng = random.Random(seed)
    out = []
    for k in range(8):
        ms = rng.randint(0, 500)
        for _ in range(25):
            ms += rng.choice([0, 200, 900, 1600, 1601, 1602, 2500, 4000, 4603, 9000])
            out.append((k, at(ms), rng.random() < 0.85))
    return out


def test_missed_frames_by_the_clock(spark):
    frames = some_frames(3) + [(50, at(0), True), (51, None, True), (52, at(0), None)]
    df = spark.createDataFrame(frames, FRAME)
    got = health.missed_frames(df, ["k"], "ts", F.col("listening"), idle_ms=10_000).collect()
    assert sorted((r["k"], r["at"]) for r in got) == plain_alarms([f for f in frames if f[1]], 10_000)
    assert [r["at"] - BASE for r in got if r["k"] == 50] == [1601, 4602, 7603]


def test_stopped_stream_raises_alarms(spark, tmp_path):
    rng = random.Random(6)
    frames = some_frames(4)
    arrival = sorted(frames, key=lambda f: f[1] + timedelta(milliseconds=rng.randint(0, 4_000)))
    end = [(99, at(10**7), False)]
    parts = [arrival[i : i + 50] for i in range(0, len(arrival), 50)] + [end, end]
    stream = lambda s: health.stream_missed_frames(s, "k", "ts", "5 seconds", F.col("listening"), idle_ms=10_000)
    got, checkpoint = run_stream(spark, tmp_path, "alarms", stream, parts, FRAME)
    assert sorted(got) == plain_alarms(frames, 10_000)
    held = spark.read.format("statestore").option("path", str(checkpoint)).option("stateVarName", "head").load()
    assert {r["key"]["k"] for r in held.select("key").collect()} <= {99}


CHUNK = "request_id long, seq long, chunk string, is_last boolean"


def test_answers_end(spark, tmp_path):
    chunks = [
        (1, 1, 'data: {"delta": "He', False),
        (1, 2, 'llo"}\n\ndata: {"choices":[{"delta":{"content":" wor"}}]}\r\n\r', False),
        (2, 3, "data: [DONE]\n\n", True),
        (1, 4, '\ndata: {bad\n\ndata: {"delta": 7}\n\ndata: {"delta": null}\n\ndata: []\n\n', False),
        (3, 5, 'data: {"delta": "never', False),
        (1, 6, 'data: {"delta": "ld"}\n\ndata: [DONE]', True),
        (4, 7, 'data: {"delta": "cut off"}\n\n', False),
        (5, 8, None, False),
    ]
    src = tmp_path / "in"
    for i in range(0, len(chunks), 3):
        spark.createDataFrame(chunks[i : i + 3], CHUNK).coalesce(1).write.mode("append").json(str(src))
    stream = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", 1).json(str(src))
    query = (
        answers.stream_answers(stream, 1500).writeStream.outputMode("append").format("memory").queryName("answers")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    )
    try:
        end = time.time() + 90
        while time.time() < end and query.isActive and spark.table("answers").where("status <> 'delta'").count() < 5:
            time.sleep(0.5)
    finally:
        query.stop()
    rows = spark.table("answers").collect()
    got = {r["request_id"]: (r["text"], r["status"]) for r in rows if r["status"] != "delta"}
    want = deltas.assemble_answers(spark.createDataFrame(chunks, CHUNK)).collect()
    assert got == {r["request_id"]: (r["answer"], r["status"]) for r in want}
    assert {r["request_id"] for r in rows if r["expired"]} == {3, 4, 5}
    assert "".join(r["text"] for r in rows if r["request_id"] == 1 and r["status"] == "delta") == "Hello world"
    held = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "head").load()
    assert held.count() == 0


def test_newest_request(spark, tmp_path):
    rng = random.Random(2)
    schema = "session long, request long, seq long, ts timestamp, text string"
    rows = [(s, rng.randint(1, 6), 100 * s + i, at(rng.randint(0, 20_000)), f"t{i}") for s in range(10) for i in range(20)]
    rows += [(77, None, 1, at(5), "x"), (78, 1, 2, None, "x"), (79, 1, 3, at(7), None)]
    parts = [rows[i : i + 60] for i in range(0, len(rows), 60)] + [[(99, 1, 0, at(10**7), "end")]] * 2
    stream = lambda s: answers.stream_latest_requests(s, "session", "request", "ts", "30 seconds", 60_000)
    got, _ = run_stream(spark, tmp_path, "newest", stream, parts, schema)
    usable = spark.createDataFrame(rows, schema).where("request IS NOT NULL AND ts IS NOT NULL")
    want = ordered.keep_latest(usable, ["session"], "request").select("session", "request", "seq", "text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
