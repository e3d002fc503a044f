"""Recognised text as it streams in: loops are cut off before they are sent.

The text of a stream is tested after every delta; at the first loop the stream
ends. What is sent lags by a fixed number of characters, so a loop can be cut
before it has been sent; what was sent can't be withdrawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tablewright.functions.text import loop_begin

#: Characters that what is sent lags behind.
HOLD_BACK = 600


class Cutter:
    """One stream's state: the text so far, how much was sent, and whether it ended."""

    def __init__(self, text: str = "", sent: int = 0, done: bool = False):
        self.text, self.sent, self.done = text, sent, done

    def add(self, delta: str | None) -> str:
        """What can be sent after one more delta."""
        if self.done:
            return ""
        self.text += delta or ""
        cut = loop_begin(self.text)
        if cut is not None:
            self.text, self.done = self.text[:cut], True
            return self.finish()
        return self._upto(len(self.text) - HOLD_BACK)

    def finish(self) -> str:
        self.done = True
        return self._upto(len(self.text))

    def _upto(self, end: int) -> str:
        out = self.text[self.sent: max(end, self.sent)]
        self.sent = max(end, self.sent)
        return out


def cut_streams(deltas: DataFrame) -> DataFrame:
    """(stream_id, text): the batch twin, over all deltas (stream_id, seq, delta) in order of seq.

    A stream's text is gathered in one task; streams are bounded by the
    service's token limit.
    """
    kind = deltas.schema["stream_id"].dataType
    streams = deltas.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "delta"))).alias("deltas"))

    def run(batches):
        for batch in batches:
            out = []
            for rows in batch.column(1).to_pylist():
                cutter = Cutter()
                said = [cutter.add(r["delta"]) for r in rows]
                out.append("".join(said) + ("" if cutter.done else cutter.finish()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["stream_id", "text"])

    return streams.mapInArrow(run, T.StructType([T.StructField("stream_id", kind), T.StructField("text", T.StringType())]))


class _Processor(StatefulProcessor):
    """Keeps a Cutter for each stream; a null delta with ``last`` ends it."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("stream", T.StructType([T.StructField("text", T.StringType()), T.StructField("sent", T.LongType()), T.StructField("done", T.BooleanType()), T.StructField("pieces", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.state.get() if self.state.exists() else ("", 0, False, 0)
        cutter, pieces = Cutter(now[0], int(now[1]), bool(now[2])), int(now[3])
        out: list[str] = []
        frame = pd.concat(list(rows)).sort_values("seq")
        for delta, last in zip(frame["delta"], frame["last"]):
            out.append(cutter.add(delta if isinstance(delta, str) else None))
            if last and not cutter.done:
                out.append(cutter.finish())
        text = "".join(out)
        # A stream that ended keeps a mark only, not its text.
        self.state.update(("" if cutter.done else cutter.text, cutter.sent, cutter.done, pieces + bool(text)))
        if text:
            yield pd.DataFrame({"stream_id": [key[0]], "piece": [pieces], "text": [text]})

    def close(self) -> None:
        pass


def cut_stream(deltas: DataFrame) -> DataFrame:
    """(stream_id, piece, text) of a streaming frame (stream_id, seq, delta, last), keyed by stream."""
    kind = deltas.schema["stream_id"].dataType
    schema = T.StructType([T.StructField("stream_id", kind), T.StructField("piece", T.LongType()), T.StructField("text", T.StringType())])
    return deltas.groupBy("stream_id").transformWithStateInPandas(_Processor(), schema, "Append", "None")


def sse_deltas(lines: DataFrame, *, stream: str = "stream_id", seq: str = "seq", line: str = "line", status: str | None = None) -> DataFrame:
    """(stream_id, seq, delta, usage) of server-sent lines; others are dropped.

    A stream whose ``status`` isn't 200 gives one delta with the error.
    """
    payload = "struct<usage:struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>,choices:array<struct<delta:struct<content:string>>>>"
    fine = lines if status is None else lines.where(F.col(status) == 200)
    parsed = fine.where(F.startswith(line, F.lit("data: {"))).withColumn("p", F.from_json(F.substring(line, 7, 1 << 30), payload))
    said = F.array_join(F.transform(F.coalesce("p.choices", F.array().cast("array<struct<delta:struct<content:string>>>")), lambda c: F.coalesce(c["delta"]["content"], F.lit(""))), "")
    out = parsed.select(F.col(stream).alias("stream_id"), F.col(seq).alias("seq"), said.alias("delta"), F.col("p.usage").alias("usage"))
    if status is None:
        return out
    failed = lines.where(F.col(status) != 200).groupBy(F.col(stream).alias("stream_id")).agg(F.min(seq).alias("seq"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(line).alias("l")))), lambda x: x["l"]), "\n").alias("e"))
    error = failed.select("stream_id", "seq", F.concat(F.lit("[OCR error: "), "e", F.lit("]")).alias("delta"), F.lit(None).cast("struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>").alias("usage"))
    return out.unionByName(error)
