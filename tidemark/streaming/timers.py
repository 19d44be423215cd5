"""Work at a set time after a worker is first heard of: once, or again and again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.sources.streams import files_at_once, write_in_order
from tidemark.storage import new_folder
from tidemark.streaming.replay import only_with_data, rocksdb_state

RUNS = "worker long, run int, registered_ms long, due_ms long, fired_ms long"


class Timer(StatefulProcessor):
    """State per worker: when it was first heard of, and how often its timer has fired."""

    def __init__(self, after_ms: int, every_ms: int | None):
        self.after_ms, self.every_ms = after_ms, every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fired = handle.getValueState("fired", "registered long, runs int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        if not self.fired.exists():
            now = timerValues.getCurrentProcessingTimeInMs()
            self.fired.update((now, 0))
            self.handle.registerTimer(now + self.after_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, due = timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs()
        registered, runs = self.fired.get()
        self.fired.update((registered, runs + 1))
        if self.every_ms is not None:
            self.handle.registerTimer(now + self.every_ms)
        yield pd.DataFrame({"worker": [key[0]], "run": [runs + 1], "registered_ms": [registered], "due_ms": [due], "fired_ms": [now]})

    def close(self) -> None:
        pass


def _each_worker_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0).unique()], schema=batch.schema)


def timed_runs(messages: DataFrame, after_ms: int, every_ms: int | None = None) -> DataFrame:
    """A row each time a worker's timer fires, for a stream with a column ``worker``.

    The timer is set when a worker is first heard of and fires once
    ``after_ms`` have passed; further messages change nothing.  Without
    ``every_ms`` it is used up then, else it is set again from the time it
    fired.  Spark looks at timers once a micro-batch, so ``fired_ms`` may be
    later than ``due_ms`` but not earlier.  What is due after the last
    micro-batch of a query that stops fires when the query goes on.  A NULL
    worker is a worker.  Which workers are heard of is worked out where the
    messages are read, so a busy worker's messages do not meet in one task.
    Start the query inside :func:`rocksdb_state`.
    """
    heard = messages.select("worker")
    return heard.mapInArrow(_each_worker_once, heard.schema).groupBy("worker").transformWithStateInPandas(
        statefulProcessor=Timer(after_ms, every_ms), outputStructType=RUNS, outputMode="Append", timeMode="ProcessingTime"
    )


def timed_on_events(spark: SparkSession, sf: str, workers: int, every_ms: int | None = None, least_batches: int = 5, rows_per_file: int = 250_000) -> DataFrame:
    """Timers of the workers heard of in `events`, over several micro-batches."""
    heard = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % workers).alias("worker"), "event_id")
    folder = new_folder(spark, "timed")
    files = write_in_order(heard, ["event_id"], f"{folder}/in", rows_per_file, least_batches)
    with rocksdb_state(spark, workers), only_with_data(spark):
        reader = spark.readStream.schema(heard.schema)
        stream = reader.option("maxFilesPerTrigger", files_at_once(files, least_batches, most=None)).parquet(f"{folder}/in")
        sink = timed_runs(stream, 1, every_ms).writeStream.format("parquet").option("path", f"{folder}/runs")
        sink.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(RUNS).parquet(f"{folder}/runs")
