"""Transcript fold, stream = batch, delta assembly, sessions and signals."""

import time

import pytest
from pyspark.sql import functions as F

from gleaner.operators import sessions
from gleaner.streaming import deltas, merge, transcripts


@pytest.mark.parametrize(
    ("previous", "incoming", "merged"),
    [
        ("", " 你好 ", "你好"),
        ("你好", "", "你好"),
        ("什么是RAG", "什么是RAG?", "什么是RAG？"),
        ("什么是", "什么是RAG", "什么是RAG"),
        ("什么是RAG和Agent", "什么是RAG", "什么是RAG和Agent"),
        ("请介绍一下你的", "你的项目", "请介绍一下你的项目"),
        ("策略 Agent 跟归因引擎", "策略有什么区别", "策略 Agent 跟归因引擎有什么区别"),
        ("前半句", "完全不同", "前半句完全不同"),
        ("介绍一下项目介绍一下项目？", "", "介绍一下项目？"),
        ("ＡＢＣ", "abcd", "abcd"),
    ],
)
def test_merge(previous, incoming, merged):
    assert merge.merge_transcript(previous, incoming) == merged


def test_merge_is_idempotent():
    for text in ("什么是 RAG？", "a b c", "你们项目的指标怎么算", "x"):
        assert merge.merge_transcript(text, text) == merge.display_form(text)
        assert merge.merge_transcript("", text) == merge.display_form(text)


EVENTS = [
    # session, capture, seq, type, text, final
    (1, 1, 1, "result", "什么是", False),
    (1, 1, 2, "result", "什么是RAG", False),
    (1, 1, 3, "result", "什么是RAG？", True),  # a segment ends, the recording goes on
    (1, 1, 4, "result", "怎么用", True),
    (1, 1, 5, "stop", None, False),
    (1, 1, 6, "result", "尾巴", True),
    (1, 1, 7, "result", "多余的话", True),
    (1, 2, 8, "result", "第二题", False),
    (1, 1, 9, "result", "旧的", True),
    (1, 2, 10, "stop", None, False),
    (4, 1, 1, "result", "还在等", True),
    (4, 1, 2, "stop", None, False),
    (4, 2, 3, "result", "新的", True),
    (4, 2, 4, "result", "没有停止", True),
    (2, 1, 8, "result", "会中断", False),
    (2, 1, 9, "error", None, False),
    (2, 2, 10, "result", "等待最终", False),
    (2, 2, 11, "stop", None, False),
    (2, 2, 12, "closed", None, False),
    (3, 5, 13, "result", "  ", True),
    (3, 5, 14, "ready", None, False),
    (3, 5, 15, "stop", None, False),
    (3, 5, 16, "result", "最后的问题", True),
]
SCHEMA = "session_id long, capture_id long, seq long, type string, text string, is_final boolean"
WANT = [
    (1, 1, "什么是RAG？怎么用尾巴", "final"),
    (1, 2, "第二题", "timeout"),
    (2, 2, "等待最终", "closed"),
    (3, 5, "最后的问题", "final"),
    (4, 1, "还在等", "superseded"),
]


def test_batch_captures(spark):
    got = transcripts.fold_captures(spark.createDataFrame(EVENTS, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == WANT


def wait_for(query, done, seconds=60):
    # A processing-time stream with timers always has another batch due, so it is polled instead of drained.
    end = time.time() + seconds
    while time.time() < end and query.isActive and not done():
        time.sleep(0.5)


def test_stream_captures_equal_batch(spark, tmp_path):
    src = tmp_path / "in"
    for part in (EVENTS[:6], EVENTS[6:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(str(src))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(src))
    out = transcripts.stream_captures(stream, wait_ms=500)
    query = (
        out.writeStream.outputMode("append").format("memory").queryName("captures")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    )
    try:
        wait_for(query, lambda: spark.table("captures").count() >= len(WANT))
    finally:
        query.stop()
    assert sorted(map(tuple, spark.table("captures").collect())) == WANT


CHUNKS = [
    (1, 1, 'data: {"delta": "He', False),
    (1, 2, 'llo"}\n\ndata: {"choices":[{"delta":{"content":" wor"}}]}\r\n\r', False),
    (1, 3, '\ndata: {bad\n\ndata: {"delta": 7}\n\ndata: {"delta": null}\n\n', False),
    (1, 4, 'data: {"delta": "ld"}\n\ndata: [DONE]', True),
    (2, 5, "data: [DONE]\n\n", True),
]


def test_answers(spark, tmp_path):
    c = spark.createDataFrame(CHUNKS, "request_id long, seq long, chunk string, is_last boolean")
    got = {r.request_id: (r.answer, r.status) for r in deltas.assemble_answers(c).collect()}
    assert got == {1: ("Hello world", "ready"), 2: ("", "error")}
    src = tmp_path / "in"
    c.coalesce(1).write.json(str(src))
    out = deltas.stream_deltas(spark.readStream.schema(c.schema).json(str(src)))
    query = (
        out.writeStream.outputMode("append").format("memory").queryName("deltas")
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    rows = spark.table("deltas").orderBy("request_id", "seq", "pos").collect()
    assert "".join(r.delta for r in rows if r.request_id == 1) == "Hello world"


def test_messages(spark):
    raw = [
        '{"sentences": {"sentence_list": [{"sentence": "a", "sentence_type": 1}, {"sentence": "b"}]}}',
        '{"sentences": {"sentence": "c", "speaker_id": 4}}',
        '{"speaker_sentences": [{"sentence": "d"}]}',
        "{bad",
    ]
    m = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    assert [r.sentence for r in transcripts.flatten_sentences(m).orderBy("i", "pos").collect()] == ["a", "b", "c", "d"]
    raw = ['{"result": {"text": " full "}}', '{"result": {"utterances": [{"text": "x"}, {"text": "last"}]}}', '{"result": {}}', "{"]
    m = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    got = transcripts.result_rows(m).orderBy("i").collect()
    assert [(r.text, r.is_cumulative) for r in got] == [("full", True), ("last", False)]


def test_signal(spark):
    samples = [0.5, 0.5, 0.5, -2.0, -2.0, -2.0, 2.0, 2.0, 2.0, 0.1]
    s = spark.createDataFrame([(1, i, v) for i, v in enumerate(samples)], "stream_id int, idx long, sample double")
    got = sessions.resample_pcm16(s, source_rate=48_000).orderBy("bucket").collect()
    assert [r.pcm for r in got] == [int(0.5 * 32767), -32768, 32767]
    # ratio 2.75625: the reference bounds are floor(i * ratio) .. floor((i + 1) * ratio)
    got = sessions.resample_pcm16(s, source_rate=44_100).orderBy("bucket").collect()
    ratio = 44_100 / 16_000
    want = []
    for i in range(int(len(samples) / ratio)):
        part = samples[int(i * ratio) : min(int((i + 1) * ratio), len(samples))]
        mean = max(-1.0, min(1.0, sum(part) / len(part)))
        want.append(int(mean * (0x8000 if mean < 0 else 0x7FFF)))
    assert [r.pcm for r in got] == want
    with pytest.raises(ValueError):
        sessions.resample_pcm16(s, source_rate=8_000)


def test_throttled_gaps(spark):
    at = [0, 1000, 3000, 4000, 9000, 12_500, 13_000, 20_000]
    d = spark.createDataFrame([(1, ms) for ms in at], "k int, ms long").withColumn("ts", F.timestamp_millis("ms"))
    gaps = sessions.frame_gaps(d, ["k"], "ts", block=F.floor(F.col("ms") / 2500)).orderBy("ms")
    assert [r.gap_ms for r in gaps.collect()] == [None, 1000, 2000, 1000, 5000, 3500, 500, 7000]
    kept = sessions.throttle(gaps.filter("stale"), ["k"], "ts", 6_000).orderBy("ms")
    assert [r.ms for r in kept.collect()] == [3000, 12_500, 20_000]
