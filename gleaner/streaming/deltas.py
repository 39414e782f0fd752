"""Server-sent delta streams: extraction of text deltas and assembly per request."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleaner.functions import text as tx

_FRAME_END = r"\r?\n\r?\n"
STATE_SCHEMA = "pending string"
STREAM_SCHEMA = "request_id long, seq long, frames string"


def payload_deltas(payload: Column | str) -> Column:
    """Text deltas of a payload, in order: ``data:`` lines that hold JSON with a string ``delta`` or choice content."""
    lines = F.filter(F.split(tx.col(payload), r"\r?\n"), lambda line: F.startswith(line, F.lit("data: ")))
    data = F.filter(
        F.transform(lines, lambda line: tx.trim(F.substring(line, 7, 2**30))), lambda d: (d != "") & (d != "[DONE]")
    )

    def delta(doc: Column) -> Column:
        value = F.try_parse_json(doc)
        first = F.try_variant_get(value, "$.delta", "variant")
        fallback = F.try_variant_get(value, "$.choices[0].delta.content", "variant")
        absent = first.isNull() | F.coalesce(F.is_variant_null(first), F.lit(True))
        chosen = F.when(absent, fallback).otherwise(first)
        return F.when(F.schema_of_variant(chosen) == "STRING", F.try_variant_get(chosen, "$", "string"))

    return F.filter(F.transform(data, delta), lambda d: d.isNotNull() & (d != ""))


def extract_deltas(events: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per delta with its position inside the payload."""
    carried = [c for c in events.columns if c != payload]
    return events.select(*carried, F.posexplode(payload_deltas(payload)).alias("pos", "delta"))


def assemble_answers(chunks: DataFrame, request: str = "request_id", order: str = "seq", chunk: str = "chunk") -> DataFrame:
    """``(request_id, answer, status)``: chunks joined in order, so frames cut between chunks are whole again.

    A group is one answer, whose text is one output value; an answer without text gets status ``error``.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(chunk, F.lit("")).alias("c"))))
    whole = chunks.groupBy(request).agg(ordered.alias("x"))
    text = F.array_join(F.transform("x", lambda x: x["c"]), "")
    answer = whole.select(request, F.array_join(payload_deltas(text), "").alias("answer"))
    return answer.withColumn("status", F.when(F.col("answer") == "", "error").otherwise("ready"))


def _complete_frames(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Cut a request's byte stream at frame ends; the unfinished rest stays in state until the next chunk."""
    pending = state.get[0] if state.exists else ""
    out = []
    frame = pd.concat(list(batches)).sort_values("seq", kind="stable")
    for row in frame.itertuples(index=False):
        pending += row.chunk or ""
        cut = max(pending.rfind("\n\n"), pending.rfind("\n\r\n"))
        if cut >= 0:
            end = cut + (3 if pending.startswith("\n\r\n", cut) else 2)
            out.append((key[0], row.seq, pending[:end]))
            pending = pending[end:]
        if row.is_last and pending:
            out.append((key[0], row.seq, pending))
            pending = ""
    if frame["is_last"].any():
        state.remove()
    else:
        state.update((pending,))
    yield pd.DataFrame(out, columns=["request_id", "seq", "frames"])


def stream_deltas(chunks: DataFrame) -> DataFrame:
    """Stream of ``(request_id, seq, pos, delta)`` from ``(request_id, seq, chunk, is_last)`` rows."""
    frames = (
        chunks.select("request_id", "seq", "chunk", "is_last")
        .groupBy("request_id")
        .applyInPandasWithState(_complete_frames, STREAM_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
    )
    return extract_deltas(frames, "frames")
