"""Structured Streaming twins: windowed usage, the append log, the rate limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def windowed_usage(events: DataFrame, *, ts: str = "ts", by: str = "event_type", width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(start, by, n, total): counts and value sums in tumbling windows; late rows beyond ``delay`` are dropped."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    out = e.groupBy(F.window("_ts", width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), by, "n", "total")


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append everything available to Parquet files; restarts go on where the checkpoint ends."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def run_complete(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write the whole aggregate of everything available to Parquet files at ``path``."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()


class Admission(StatefulProcessor):
    """State of one key: admission times of the last ``rpm`` calls, oldest first.

    The calls of one trigger are admitted by their time. A call that comes in a later trigger than a younger one is late:
    it is admitted after those, no earlier than its own time, as a limiter that has already let them through must.
    """

    def __init__(self, rpm: int, window: float = 60.0):
        self.rpm, self.window = rpm, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getListState("past", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        past = [r[0] for r in self.past.get()] if self.past.exists() else []
        b = pd.concat(list(rows)).sort_values(["at", "event_id"])  # a key's calls of a trigger, in however many batches
        out = []
        for at in b["at"]:
            t = max(at, past[-self.rpm] + self.window) if len(past) >= self.rpm else at
            past = [*past, t][-self.rpm :]
            out.append(t)
        yield pd.DataFrame({"user_id": key[0], "event_id": b["event_id"].to_numpy(), "admitted": out})
        self.past.put([(t,) for t in past])

    def close(self) -> None:
        pass


def streamed_admissions(calls: DataFrame, rpm: int, window: float = 60.0) -> DataFrame:
    """(user_id, event_id, admitted) of a stream of calls (user_id, event_id, at)."""
    return calls.groupBy("user_id").transformWithStateInPandas(
        Admission(rpm, window), outputStructType="user_id long, event_id long, admitted double", outputMode="append", timeMode="none"
    )
