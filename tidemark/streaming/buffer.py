"""The adaptive buffer as a stateful stream, and the arrival rate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.columns import BUFFER_COEFFICIENT, DEFAULT_GAP_MS, GAP_HISTORY, MAX_BUFFER, MIN_BUFFER, epoch_ms
from tidemark.operators.prep import shard_rows
from tidemark.operators.runlog import latest
from tidemark.sources.streams import files_at_once, write_in_order
from tidemark.storage import new_folder, written
from tidemark.streaming.replay import rocksdb_state, table_stream

OUTPUT = "shard long, id long, t_ms long, n long, target long, occupancy long, evicted_from long, evicted_to long"


class BufferProcessor(StatefulProcessor):
    """State per shard: counters, the last arrival times and the rows in the buffer.

    The rows of one micro-batch are put in ``(t_ms, id)`` order, so a task holds
    a shard's part of one micro-batch, which is bounded at the source:
    ``maxOffsetsPerTrigger``, or ``maxFilesPerTrigger`` over files that
    :func:`tidemark.sources.streams.write_in_order` made.
    """

    def __init__(self, low: int, high: int, coefficient: float, history: int, payload: str):
        self.low, self.high, self.coefficient, self.history, self.payload = low, high, coefficient, history, payload

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", "n long, floor long")
        self.times = handle.getListState("times", "t_ms long")
        self.rows = handle.getMapState("rows", "insertion_id long", f"id long, t_ms long, {self.payload}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield self.take_in(key[0], pd.concat(list(rows), ignore_index=True))

    def take_in(self, shard: int, new: pd.DataFrame) -> pd.DataFrame:
        """Put rows into the buffer; what each of them did there."""
        new = new.sort_values(["t_ms", "id"], kind="stable").reset_index(drop=True)
        n0, floor0 = self.counters.get() if self.counters.exists() else (0, np.iinfo(np.int64).max)
        earlier = np.array([r[0] for r in self.times.get()], dtype=np.int64)
        times = np.concatenate([earlier, new["t_ms"].to_numpy(np.int64)])
        target = self._targets(times)[len(earlier):]
        n = n0 + 1 + np.arange(len(new))
        floor = np.minimum.accumulate(np.concatenate([[floor0], target - n]))
        released = np.maximum(0, -floor)
        out = pd.DataFrame(
            {
                "shard": shard,
                "id": new["id"],
                "t_ms": new["t_ms"],
                "n": n,
                "target": target,
                "occupancy": n + np.minimum(0, floor[1:]),
                "evicted_from": released[:-1] + 1,
                "evicted_to": released[1:],
            }
        )
        for gone in range(int(released[0]) + 1, min(int(released[-1]), n0) + 1):
            self.rows.removeKey((gone,))
        kept = new[n > released[-1]]
        names = [c for c in new.columns if c not in ("shard", "id", "t_ms")]
        for number, row in zip(n[n > released[-1]].tolist(), kept[["id", "t_ms", *names]].itertuples(index=False)):
            self.rows.updateValue((number,), tuple(row))
        self.counters.update((int(n[-1]), int(floor[-1])))
        self.times.put([(int(t),) for t in times[-(self.history + 1):]])
        return out

    def _targets(self, times: np.ndarray) -> np.ndarray:
        place = np.arange(len(times))
        gaps = np.minimum(place, self.history)
        span = times - times[place - gaps]
        mean = np.where(gaps > 0, span / np.maximum(gaps, 1), DEFAULT_GAP_MS)
        with np.errstate(divide="ignore"):
            wanted = np.floor(self.coefficient * 60000 / mean + 0.5)
        return np.where(mean > 0, np.clip(wanted, self.low, self.high), self.high).astype(np.int64)

    def close(self) -> None:
        pass


def adaptive_buffer(
    stream: DataFrame,
    low: int = MIN_BUFFER,
    high: int = MAX_BUFFER,
    coefficient: float = BUFFER_COEFFICIENT,
    history: int = GAP_HISTORY,
    payload: str = "value double",
) -> DataFrame:
    """For each arrival: its insertion id, the buffer size and the ids it pushed out.

    ``stream`` has ``shard``, ``id``, ``t_ms`` and the ``payload`` columns.
    Start the query inside :func:`rocksdb_state`.
    """
    names = [f.name for f in T.StructType.fromDDL(payload).fields]
    return (
        stream.select("shard", "id", "t_ms", *names)
        .groupBy("shard")
        .transformWithStateInPandas(
            statefulProcessor=BufferProcessor(low, high, float(coefficient), history, payload),
            outputStructType=OUTPUT,
            outputMode="Append",
            timeMode="None",
        )
    )


def arrival_rate_stream(stream: DataFrame, minutes: int = 1, watermark: str | None = None) -> DataFrame:
    """Rows per shard and tumbling window of event time ``ts``."""
    rows = stream.withWatermark("ts", watermark) if watermark else stream
    return rows.groupBy("shard", F.window("ts", f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("rows"))


def buffered_rows(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """What the buffers of a query held after its last (or the given) micro-batch, read from its checkpoint.

    ``shard, insertion_id, id, t_ms`` and the payload columns.
    """
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "rows")
    if batch is not None:
        reader = reader.option("batchId", batch)
    return reader.load().select("key.shard", "user_map_key.insertion_id", "user_map_value.*")


def run_on_events(
    spark: SparkSession, sf: str, workers: int, low: int, high: int, coefficient: float, least_batches: int = 10, rows_per_file: int = 250_000
) -> tuple[DataFrame, DataFrame]:
    """The stateful buffer over `events` in many bounded micro-batches: what it did at each arrival, and what it holds."""
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("id"), epoch_ms("ts").alias("t_ms"), "value")
    folder = new_folder(spark, "buffer")
    files = write_in_order(shard_rows(events, "id", workers), ["t_ms", "id"], f"{folder}/in", rows_per_file, least_batches)
    schema = "id long, t_ms long, value double, shard long"
    with rocksdb_state(spark, workers):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once(files, least_batches)).parquet(f"{folder}/in")
        out = adaptive_buffer(stream, low, high, coefficient)
        sink = out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
        sink.trigger(availableNow=True).start().awaitTermination()
        held = written(buffered_rows(spark, f"{folder}/checkpoint"), "held")
    done = spark.read.schema(OUTPUT).parquet(f"{folder}/rows").select("id", "shard", "n", "target", "occupancy")
    return done, held.select("id", "shard", "insertion_id", "value")


def rate_on_events(spark: SparkSession, sf: str, workers: int, minutes: int) -> DataFrame:
    """Windows are emitted as they change; the table keeps the last count of each."""
    events = shard_rows(table_stream(spark, sf, "events"), "event_id", workers)
    folder = new_folder(spark, "rate")

    def store(batch: DataFrame, number: int) -> None:
        start = epoch_ms(F.col("w.start").cast("timestamp_ntz"))
        batch.select("shard", start.alias("window_ms"), "rows").write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    rate = arrival_rate_stream(events, minutes)
    sink = rate.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{folder}/checkpoint")
    sink.trigger(availableNow=True).start().awaitTermination()
    counts = spark.read.schema("shard long, window_ms long, rows long, batch long").parquet(f"{folder}/rows")
    return latest(counts, ["shard", "window_ms"], ["batch"]).drop("batch")
