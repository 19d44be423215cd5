"""Clocks of incoming deltas: each worker's next clock is known, and anything else goes to a side output."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.sources.streams import files_at_once, write_in_order
from tidemark.storage import dropped, new_folder, written
from tidemark.streaming.replay import only_with_data, rocksdb_state

DAY_MS = 86_400_000
TRACKED = "worker long, sent long, clock long, expected long, fault string"
REPEAT, GAP = "repeat", "gap"


class ClockTracker(StatefulProcessor):
    """State per worker: the clock that its next delta must have, dropped when the worker is silent for ``ttl_ms``."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.expected = handle.getValueState("expected", "clock long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values("sent", kind="stable")
        expected = self.expected.get()[0] if self.expected.exists() else 0
        before, faults = [], []
        for clock in new["clock"].tolist():
            before.append(expected)
            faults.append(None if clock == expected else REPEAT if clock < expected else GAP)
            expected += clock == expected
        self.expected.update((int(expected),))
        yield pd.DataFrame({"worker": key[0], "sent": new["sent"], "clock": new["clock"], "expected": before, "fault": faults})

    def close(self) -> None:
        pass


def track_clocks(deltas: DataFrame, ttl_ms: int = DAY_MS) -> DataFrame:
    """Every delta of ``worker, clock, sent`` with the clock that was expected and its fault, NULL for none.

    Deltas of one micro-batch are judged in the order of ``sent``.  A delta
    with another clock than expected is a repeat or leaves a gap; it changes
    nothing.  Start the query inside :func:`rocksdb_state`, and a query that is
    to stop by itself inside :func:`only_with_data`.
    """
    return deltas.select("worker", "clock", "sent").groupBy("worker").transformWithStateInPandas(
        statefulProcessor=ClockTracker(ttl_ms), outputStructType=TRACKED, outputMode="Append", timeMode="ProcessingTime"
    )


def fault_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: good deltas to ``deltas``, the others to ``faults``, each under its batch number."""

    def store(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, rows in (("deltas", batch.filter("fault is null")), ("faults", batch.filter("fault is not null"))):
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/number={number}")
        batch.unpersist()

    return store


def tracked_events(spark: SparkSession, trace: DataFrame, workers: int, least_batches: int = 5, rows_per_file: int = 250_000) -> DataFrame:
    """A recorded run sent with repeats and leaps among its deltas, over several micro-batches; all that came out.

    Every seventh event is sent a second time, every eleventh is followed by
    a delta five clocks ahead.
    """
    again = F.when(F.col("event_id") % 7 == 0, F.struct(F.col("clock").alias("clock"), F.lit(1).alias("turn")))
    ahead = F.when(F.col("event_id") % 11 == 0, F.struct((F.col("clock") + 5).alias("clock"), F.lit(2).alias("turn")))
    first = F.struct(F.col("clock").alias("clock"), F.lit(0).alias("turn"))
    sent = trace.select("worker", "event_id", F.explode(F.array_compact(F.array(first, again, ahead))).alias("m"))
    sent = sent.select("worker", F.col("m.clock").cast("long").alias("clock"), (F.col("event_id") * 3 + F.col("m.turn")).cast("long").alias("sent"))
    folder = new_folder(spark, "tracked")
    sent = written(sent, "sent")  # counted, sampled and dealt out, but worked out once
    files = write_in_order(sent, ["sent"], f"{folder}/in", rows_per_file, least_batches)
    dropped(sent)
    with rocksdb_state(spark, workers), only_with_data(spark):
        reader = spark.readStream.schema("worker long, clock long, sent long")
        stream = reader.option("maxFilesPerTrigger", files_at_once(files, least_batches)).parquet(f"{folder}/in")
        sink = track_clocks(stream).writeStream.foreachBatch(fault_sink(folder)).option("checkpointLocation", f"{folder}/checkpoint")
        sink.trigger(availableNow=True).start().awaitTermination()
    good, faults = (spark.read.schema(TRACKED).parquet(f"{folder}/{name}") for name in ("deltas", "faults"))
    return good.withColumn("output", F.lit("deltas")).unionByName(faults.withColumn("output", F.lit("faults"))).drop("number")
