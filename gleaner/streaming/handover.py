"""Submitted captures become questions: one folder for each micro-batch, so that a batch that runs again adds nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from gleaner.functions import text as tx
from gleaner.operators import turns
from gleaner.streaming.captures import LATE

QUESTION_SCHEMA = T.StructType(
    [
        T.StructField("session_id", T.LongType()),
        T.StructField("capture_id", T.LongType()),
        T.StructField("query", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)


def questions_of(captures: DataFrame) -> DataFrame:
    """``(session_id, capture_id, query, reason)``: the latest question in each submitted capture's display form. Late
    events and captures without a question are left out."""
    usable = captures.where(F.col("text").isNotNull() & (F.col("reason") != LATE))
    shown = turns.clean_display(usable.select("session_id", "capture_id", "text", "reason"), "text")
    said = turns.collapse_repeats("text")
    asked = shown.withColumn("query", tx.trim(turns.latest_question(said)))
    return asked.where("query <> ''").select(*QUESTION_SCHEMA.names)


def write_batch(captures: DataFrame, batch_id: int, path: str) -> None:
    """The batch's questions in a folder of its own, replacing what an earlier attempt left there."""
    questions_of(captures).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def hand_over(captures: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Runs the stream of submitted captures (``stream_captures`` or ``stream_by_time``) into the question table at
    ``path``. A batch id belongs to one checkpoint, so a path takes one stream."""
    sink = captures.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if trigger:
        sink = sink.trigger(**trigger)
    return sink.foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, path)).start()


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """All questions handed over so far."""
    return spark.read.schema(QUESTION_SCHEMA).parquet(f"{path}/batch=*")
