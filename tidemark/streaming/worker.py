"""A training run whose workers and server talk in messages.

A worker is one stateful operator over two message streams, its examples and
the weights it is sent; its state holds its buffer and the weights that it has
not trained on yet.  The server takes the workers' deltas batch by batch, adds
them to the shared weights and sends a new version to every worker that the
release rule lets go on.  All that passes between them are tagged messages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessorHandle, StreamingQuery

from tidemark.functions import softmax
from tidemark.functions.columns import BUFFER_COEFFICIENT, GAP_HISTORY, LOCAL_ITERATIONS, MAX_BUFFER, MIN_BUFFER, NUM_WORKERS, sparse_map
from tidemark.operators.weights import KEY, combine, from_flat, to_flat
from tidemark.sources import messages
from tidemark.sources.streams import GRADIENTS, INPUT_DATA, WEIGHTS, append_messages, read_messages
from tidemark.streaming.buffer import BufferProcessor
from tidemark.streaming.replay import rocksdb_state
from tidemark.streaming.training import TrainingStore, next_release

#: An example says when it arrived and which it is; the other fields are those of the message format.
TIMED_EXAMPLE = T.StructType([*messages.SCHEMAS[messages.LABELED].fields, T.StructField("time", T.LongType()), T.StructField("id", T.LongType())])
DELTAS = "worker long, clock int, loss double, rows long, seen long, keys array<int>, deltas array<float>"
MODEL = "class int, feature int, value double"


class WorkerProcessor(BufferProcessor):
    """One worker: examples go to its buffer, weights are trained on what the buffer holds then.

    The examples of a micro-batch are taken in before its weights.  Weights
    that come before any example wait for one; weights of a clock that was
    trained already are a repeat and say nothing.
    """

    def __init__(self, classes: int, width: int, low: int, high: int, coefficient: float, history: int, iterations: int, rate: float | None):
        super().__init__(low, high, coefficient, history, "label int, keys binary, x binary")
        self.classes, self.width, self.iterations, self.rate = classes, width, iterations, rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getMapState("waiting", "clock int", "keys binary, x binary")
        self.trained = handle.getValueState("trained", "clock int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        new["keys"] = [np.asarray(k, dtype="<i4").tobytes() for k in new["keys"]]
        new["x"] = [np.asarray(x, dtype="<f8").tobytes() for x in new["x"]]
        sent = new["clock"].notna()
        if not sent.all():
            self.take_in(key[0], new.loc[~sent, ["id", "t_ms", "label", "keys", "x"]].astype({"label": "int32"}))
        last = self.trained.get()[0] if self.trained.exists() else -1
        for clock, keys, x in zip(new.loc[sent, "clock"].astype(int), new.loc[sent, "keys"], new.loc[sent, "x"]):
            if clock > last:
                self.waiting.updateValue((clock,), (keys, x))
        if not (self.waiting.exists() and self.rows.exists()):
            return
        x, y = self._buffered()
        for (clock,), (keys, values) in sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator()):
            old = self._model(bytes(keys), bytes(values))
            if self.rate is None:
                delta, loss = softmax.fit_block(x, y, old, self.iterations)
            else:
                loss, gradient = softmax.loss_and_gradient(x, y, old)
                delta, loss = -self.rate * gradient / len(y), loss / len(y)
            self.waiting.removeKey((clock,))
            self.trained.update((clock,))
            flat = np.append(delta[:, 1:].T.ravel(), delta[:, 0]).astype(np.float32)
            row = {"worker": key[0], "clock": clock, "loss": loss, "rows": len(y), "seen": self.counters.get()[0]}
            yield pd.DataFrame({k: [v] for k, v in row.items()} | {"keys": [np.arange(len(flat), dtype=np.int32)], "deltas": [flat]})

    def _buffered(self) -> tuple[np.ndarray, np.ndarray]:
        held = [tuple(v) for _, v in sorted((tuple(k), tuple(v)) for k, v in self.rows.iterator())]
        names = ("id", "t_ms", "label", "keys", "x")
        block, labels = np.zeros((len(held), self.width + 1)), np.empty(len(held), dtype=np.int64)
        block[:, 0] = 1.0
        for i, values in enumerate(held):
            row = dict(zip(names, values))
            block[i, np.frombuffer(row["keys"], "<i4") + 1] = np.frombuffer(row["x"], "<f8")
            labels[i] = row["label"]
        return block, labels

    def _model(self, keys: bytes, x: bytes) -> np.ndarray:
        """Flat keys: class by class within a feature, then the intercepts."""
        flat = np.zeros(self.classes * (self.width + 1))
        flat[np.frombuffer(keys, "<i4")] = np.frombuffer(x, "<f8")
        inner = flat[: self.classes * self.width].reshape(self.width, self.classes).T
        return np.hstack([flat[self.classes * self.width :, None], inner])


def worker_input(stream: DataFrame) -> DataFrame:
    """Example and weights messages, keyed by worker, as rows for :class:`WorkerProcessor`."""
    schemas = {messages.LABELED: TIMED_EXAMPLE, messages.WEIGHTS: messages.SCHEMAS[messages.WEIGHTS]}
    rows = messages.decode(stream, schemas=schemas)
    example, weights = F.col(messages.LABELED), F.col(messages.WEIGHTS)
    entries = F.map_entries(F.coalesce(example["inputData"], weights["values"]))
    return rows.select(
        F.col("key").alias("worker"),
        example["time"].alias("t_ms"),
        example["id"].alias("id"),
        weights["vectorClock"].alias("clock"),
        example["label"].alias("label"),
        entries["key"].alias("keys"),
        F.transform(entries["value"], lambda v: v.cast("double")).alias("x"),
    )


def worker_deltas(
    stream: DataFrame,
    classes: int,
    width: int,
    *,
    low: int = MIN_BUFFER,
    high: int = MAX_BUFFER,
    coefficient: float = BUFFER_COEFFICIENT,
    history: int = GAP_HISTORY,
    iterations: int = LOCAL_ITERATIONS,
    rate: float | None = None,
) -> DataFrame:
    """What each worker answers to its weights messages: delta, local loss and rows trained on, by worker and clock.

    ``stream`` has example and weights messages, ``key`` the worker.  With
    ``rate`` a worker takes one full-batch step (and gives the loss before it),
    else a local fit.  Start the query inside :func:`rocksdb_state`.
    """
    processor = WorkerProcessor(classes, width, low, high, float(coefficient), history, iterations, rate)
    return worker_input(stream).groupBy("worker").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=DELTAS, outputMode="Append", timeMode="None"
    )


def example_messages(examples: DataFrame) -> DataFrame:
    """``key, value`` of ``shard, id, t_ms, label, features`` (an array or a feature map)."""
    features = F.col("features") if examples.schema["features"].dataType.typeName() == "map" else sparse_map("features")
    body = messages.tagged(messages.LABELED, inputData=features, label=F.col("label"), time=F.col("t_ms"), id=F.col("id"))
    return examples.select(F.col("shard").alias("key"), messages.encode(body).alias("value"))


def weights_messages(weights: DataFrame, released: DataFrame, classes: int, width: int) -> DataFrame:
    """The whole model for every ``worker, clock`` in ``released``; a message is one record."""
    flat = to_flat(weights, classes, width).agg(F.map_from_entries(F.collect_list(F.struct("key", F.col("value").cast("float")))).alias("values"))
    whole = F.lit(0), F.lit(classes * (width + 1))
    body = messages.weights_message(F.col("clock").cast("int"), *whole, F.col("values"))
    # One row with the model, and one row per worker.
    return released.join(F.broadcast(flat)).select(F.col("worker").alias("key"), messages.encode(body).alias("value"))


class MessageTraining:
    """One run in a folder: message streams, versions of the weights, clocks and deltas, all kept by batch number."""

    def __init__(self, spark: SparkSession, folder: str, classes: int, width: int, *, num_workers: int = NUM_WORKERS, delay: int = 0, **worker):
        self.spark, self.folder, self.classes, self.width = spark, folder, classes, width
        self.num_workers, self.delay, self.worker = num_workers, delay, worker
        self.store = TrainingStore(spark, f"{folder}/run")

    def start(self, weights: DataFrame) -> None:
        """Version 0 for every worker at clock 0."""
        self.store.write(weights.select(*KEY, "value"), "weights", 0)
        self.store.put_clocks(0, [(w, 0, 0, 0) for w in range(self.num_workers)])
        self._send([(w, 0) for w in range(self.num_workers)], 0)
        append_messages(self.spark.createDataFrame([], "key long, value string"), INPUT_DATA, self.folder)

    def publish(self, examples: DataFrame) -> None:
        append_messages(example_messages(examples), INPUT_DATA, self.folder)

    def run(self, trigger: dict | None = None) -> StreamingQuery:
        """Start workers and server on the messages that are there; inside :func:`rocksdb_state`."""
        streams = [read_messages(self.spark, name, folder=self.folder) for name in (INPUT_DATA, WEIGHTS)]
        deltas = worker_deltas(streams[0].unionByName(streams[1]), self.classes, self.width, **self.worker)
        writer = deltas.writeStream.foreachBatch(self._serve).option("checkpointLocation", f"{self.folder}/checkpoint")
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def _serve(self, batch: DataFrame, number: int) -> None:
        """The server's part: publish the deltas, add them up, release the next weights."""
        deltas = self.store.write(batch, "deltas", number)
        body = messages.gradient_message(
            F.col("clock"), F.lit(0), F.lit(self.classes * (self.width + 1)), F.map_from_arrays("keys", "deltas"), F.col("worker")
        )
        self.store.write(deltas.select(F.col("worker").alias("key"), messages.encode(body).alias("value")), GRADIENTS, number)
        sent = self.store.read(GRADIENTS, number, "key long, value string")
        stepped = {r["worker"]: r["seen"] for r in deltas.select("worker", "seen").collect()}  # one row per worker
        state = self.store.clocks(number)
        now = self.store.read("weights", number, MODEL)
        self.store.write(combine(now, self._added(sent), self.num_workers), "weights", number + 1)
        seen = {w: s["seen"] for w, s in state.items()} | stepped
        clocks = next_release(state, seen, stepped, self.delay, number + 1)
        self._send([(w, clock) for w, clock, version, _ in clocks if version == number + 1], number + 1)
        self.store.put_clocks(number + 1, clocks)

    def _added(self, sent: DataFrame) -> DataFrame:
        """Deltas of gradient messages in long form."""
        rows = messages.decode(sent).select(F.explode(F.col(messages.GRADIENT)["values"]).alias("key", "delta"))
        return from_flat(rows.withColumn("delta", F.col("delta").cast("double")), self.classes, self.width, "delta")

    def _send(self, released: list[tuple], version: int) -> None:
        if released:
            weights = self.store.read("weights", version, MODEL)
            to = self.spark.createDataFrame(pd.DataFrame(released, columns=["worker", "clock"]), "worker long, clock int")
            append_messages(weights_messages(weights, to, self.classes, self.width), WEIGHTS, self.folder)

    def local_weights(self) -> DataFrame:
        """``worker, clock, version, loss, rows, class, feature, value``: every worker's own weights after each of its steps."""
        deltas = self.spark.read.schema(DELTAS + ", number long").parquet(f"{self.folder}/run/deltas")
        given = self.store.all_clocks().select("number", "worker", "version")
        long = deltas.select("worker", "clock", "loss", "rows", "number", F.explode(F.map_from_arrays("keys", "deltas")).alias("key", "delta"))
        keys = from_flat(long.select("key").distinct().withColumn("_key", F.col("key")), self.classes, self.width, "_key")
        named = long.join(keys.withColumnRenamed("_key", "key"), "key").join(given, ["number", "worker"])
        weights = self.spark.read.schema(MODEL + ", number long").parquet(f"{self.folder}/run/weights").withColumnRenamed("number", "version")
        # Weights travel as 32-bit numbers.
        own = F.col("value").cast("float").cast("double") + F.col("delta").cast("double")
        return named.join(weights, ["version", *KEY]).select(
            "worker", F.col("clock").cast("long").alias("clock"), "version", "loss", "rows", *KEY, own.alias("value")
        )


def train_on_messages(examples: DataFrame, order: str, pieces: int, folder: str, run: MessageTraining, weights: DataFrame) -> DataFrame:
    """A run over ``examples`` that come in ``pieces`` along ``order``: each piece is published, then workers and server go on."""
    low, high = examples.agg(F.min(order), F.max(order)).first()
    span = (high - low) // pieces + 1
    run.start(weights)
    with rocksdb_state(run.spark):
        for piece in range(pieces):
            start = low + piece * span
            run.publish(examples.filter((F.col(order) >= start) & (F.col(order) < start + span)))
            run.run().awaitTermination()
    return run.local_weights()
