"""Training on a stream: feedback goes through tables of weights versions.

Spark streams have no cycles, so a micro-batch reads the latest version,
trains, and writes the next one.  Everything a micro-batch writes is kept
under its batch number and overwritten when the batch is replayed, so a
restart neither loses nor repeats a delta.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from tidemark.functions.columns import (
    BUFFER_COEFFICIENT,
    GAP_HISTORY,
    LOCAL_ITERATIONS,
    MAX_BUFFER,
    MIN_BUFFER,
    NUM_WORKERS,
    target_size,
)
from tidemark.operators import weights as model
from tidemark.operators.buffer import recent_mean_gap
from tidemark.operators.clocks import lets_go
from tidemark.operators.ordered import number_rows
from tidemark.operators.prep import shard_rows
from tidemark.operators.quality import f1_accuracy
from tidemark.operators.runlog import SERVER
from tidemark.operators.scoring import gradient_step, predict_versions
from tidemark.operators.weights import combine, weight_arrays, weights_frame
from tidemark.plans.training import MAX_GROUP_ROWS, local_fit
from tidemark.storage import new_folder
from tidemark.streaming.replay import replay, table_stream

CLOCKS = "worker long, clock long, version long, seen long"
WEIGHTS = "class int, feature int, value double"
METRICS = (
    "timestamp long, partition int, vectorClock int, loss double, fMeasure double, accuracy double, numTuplesSeen long, scope string"
)
SHARED, LOCAL = "shared", "local"


def advance_buffer(tail: DataFrame | None, batch: DataFrame, low: int, high: int, coefficient: float, history: int = GAP_HISTORY) -> DataFrame:
    """Buffers after a micro-batch, from the rows kept of the earlier ones.

    ``tail`` has, per shard, the rows in the buffer and at least the last
    ``history + 1`` arrivals with their number ``n`` and running ``floor``;
    with these the window expressions continue exactly where they stopped.
    A shard's part of one micro-batch is sorted in one task, so bound the
    micro-batch at the source.
    """
    rows = batch.withColumns({"_new": F.lit(1), "n": F.lit(None).cast("long"), "floor": F.lit(None).cast("long")})
    if tail is not None:
        rows = rows.unionByName(tail.drop("released").withColumn("_new", F.lit(0)))
    shard = Window.partitionBy("shard")
    order = shard.orderBy("_new", "t_ms", "id")
    numbered = rows.withColumns(
        {
            "_base": F.coalesce(F.max("n").over(shard), F.lit(0)) - F.count("n").over(shard),
            "_floor0": F.min("floor").over(shard),
            "_rn": F.row_number().over(order),
        }
    ).withColumn("n", F.coalesce(F.col("n"), F.col("_base") + F.col("_rn")))
    mean = recent_mean_gap(order, history)
    sized = numbered.withColumn("_room", F.when(F.col("_new") == 1, target_size(mean, low, high, coefficient) - F.col("n")))
    running = F.min("_room").over(order.rowsBetween(Window.unboundedPreceding, 0))
    floors = sized.withColumn("floor", F.coalesce(F.col("floor"), F.least(F.col("_floor0"), running)))
    ends = floors.withColumns(
        {
            "released": F.greatest(F.lit(0), -F.min("floor").over(shard)).cast("long"),
            "_last": F.max("n").over(shard),
        }
    )
    kept = ends.filter((F.col("n") > F.col("released")) | (F.col("n") > F.col("_last") - (history + 1)))
    return kept.select(*batch.columns, "n", "floor", "released")


@dataclass
class TrainingStore:
    """Folders of one run; ``number`` is a batch or a version and part of the path.

    The last weights and clocks written are also kept in memory, so that a
    micro-batch reads them back only after a restart.
    """

    spark: SparkSession
    folder: str
    recent: dict = field(default_factory=dict)

    def path(self, kind: str, number: int) -> str:
        return f"{self.folder}/{kind}/number={number}"

    def write(self, df: DataFrame, kind: str, number: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(kind, number))
        return self.read(kind, number, df.schema)

    def read(self, kind: str, number: int, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(kind, number))

    def write_rows(self, rows: list[tuple], schema: str, kind: str, number: int) -> None:
        """A few rows, one per worker, as one file."""
        names = T.StructType.fromDDL(schema).names
        table = pa.table([pa.array(list(column)) for column in zip(*rows)], names=names)
        self.write(self.spark.createDataFrame(table, schema).coalesce(1), kind, number)

    def remember(self, kind: str, number: int, value) -> None:
        self.recent[kind, number] = value
        for key in [k for k in self.recent if k[1] < number - 64]:
            del self.recent[key]

    def put_weights(self, version: int, weights: np.ndarray) -> None:
        self.write(weights_frame(self.spark, weights).coalesce(1), "weights", version)
        self.remember("weights", version, weights)

    def weights(self, version: int) -> np.ndarray:
        if ("weights", version) not in self.recent:
            self.remember("weights", version, weight_arrays(self.read("weights", version, WEIGHTS)))
        return self.recent["weights", version]

    def put_clocks(self, number: int, rows: list[tuple]) -> None:
        self.write_rows(rows, CLOCKS, "clocks", number)
        self.remember("clocks", number, rows)

    def clocks(self, number: int) -> dict[int, dict]:
        """Per worker: clock, version it may train on (None while held back), rows seen."""
        if ("clocks", number) not in self.recent:
            self.remember("clocks", number, [tuple(r) for r in self.read("clocks", number, CLOCKS).collect()])
        return {w: {"clock": c, "version": v, "seen": n} for w, c, v, n in self.recent["clocks", number]}

    def start(self, weights: np.ndarray, num_workers: int) -> None:
        """Version 0, given to every worker at clock 0."""
        self.put_weights(0, weights)
        self.put_clocks(0, [(w, 0, 0, 0) for w in range(num_workers)])

    def all_clocks(self) -> DataFrame:
        return self.spark.read.schema(CLOCKS + ", number long").parquet(f"{self.folder}/clocks")

    def all_metrics(self) -> DataFrame:
        return self.spark.read.schema(METRICS + ", number long").parquet(f"{self.folder}/metrics")


def train_batch(
    store: TrainingStore,
    batch: DataFrame,
    number: int,
    *,
    num_workers: int,
    delay: int,
    low: int,
    high: int,
    coefficient: float,
    iterations: int,
    test: DataFrame | None,
    rate: float | None = None,
) -> None:
    """One micro-batch: fill the buffers, let released workers step, apply their deltas, release again.

    A worker steps when it has new rows and holds released weights, and trains
    on the version of its own release.  Clocks move with the data; there is no
    hidden asynchrony.  With ``rate`` a step is one full-batch gradient step,
    else a local fit.
    """
    spark = store.spark
    kept = T.StructType([*batch.schema.fields, *T.StructType.fromDDL("n long, floor long, released long").fields])
    before = store.read("tail", number - 1, kept) if number else None
    tail = store.write(advance_buffer(before, batch, low, high, coefficient), "tail", number)
    seen = {r[0]: r[1] for r in tail.groupBy("shard").agg(F.max("n")).collect()}  # one row per worker
    state = store.clocks(number)
    stepping = {
        w: s["version"] for w, s in state.items() if s["version"] is not None and seen.get(w, 0) > s["seen"]
    }

    now = store.weights(number)
    given = {number: now} | {v: store.weights(v) for v in set(stepping.values()) - {number}}
    models = {w: given[v] for w, v in stepping.items()}
    weights, deltas = now, None
    if models:
        buffers = tail.filter((F.col("n") > F.col("released")) & F.col("shard").isin(list(models))).select("shard", "label", "features")
        if rate is None:
            fits = local_fit(buffers, models, iterations, bounded=high <= MAX_GROUP_ROWS or None)
        else:
            fits = gradient_step(buffers, models, rate)
        deltas = store.write(fits, "deltas", number)
        weights = weight_arrays(combine(weights_frame(spark, now), deltas, num_workers))
    store.put_weights(number + 1, weights)
    if test is not None:
        _write_metrics(store, number, deltas, models, weights, state, seen, test)
    store.put_clocks(number + 1, next_release(state, seen, stepping, delay, number + 1))


def next_release(state: dict[int, dict], seen: dict[int, int], stepped, delay: int, version: int) -> list[tuple]:
    """Clocks after a batch; workers the rule lets go on are given ``version``.

    The rule is that of :func:`tidemark.operators.clocks.gate`, on the one row
    per worker that the driver holds anyway.
    """
    clock = {w: s["clock"] + (w in stepped) for w, s in state.items()}
    slowest = min(clock.values())
    rows = []
    for w, s in sorted(state.items()):
        held = None if w in stepped else s["version"]
        if held is None and lets_go(clock[w], slowest, delay):
            held = version
        rows.append((w, clock[w], held, seen.get(w, 0)))
    return rows


def _write_metrics(store, number, deltas, models, weights, state, seen, test) -> None:
    """Rows of the server log (shared weights) and the worker log (each worker's local weights)."""
    losses = {SERVER: -1.0}
    scored = _quality(test, {SERVER: weights})
    # The driver holds as many workers' weights at a time as the limit takes.
    workers, step = sorted(models), max(1, model.MAX_BROADCAST_WEIGHTS // weights.size)
    for some in (workers[i : i + step] for i in range(0, len(workers), step)):
        rows = deltas.filter(F.col("shard").isin(some)).select("shard", "class", "feature", F.col("delta").alias("value"), "loss")
        local, loss = weight_arrays(rows, by="shard", also="loss")
        scored |= _quality(test, {w: models[w] + local[w] for w in local})
        losses |= loss
    now = int(time.time() * 1000)
    slowest = min(s["clock"] for s in state.values())
    out = [
        (
            now,
            int(p),
            int(state[p]["clock"] if p != SERVER else slowest),
            float(losses[p]),
            scored[p]["f1"],
            scored[p]["accuracy"],
            seen.get(p),
            SHARED if p == SERVER else LOCAL,
        )
        for p in scored
    ]
    store.write_rows(out, METRICS, "metrics", number)


def _quality(test: DataFrame, versions: dict[int, np.ndarray]) -> dict[int, dict]:
    return {r["version"]: r for r in f1_accuracy(predict_versions(test, versions, ("label",)), ["version"]).collect()}


def train_stream(
    stream: DataFrame,
    folder: str,
    weights: np.ndarray,
    *,
    num_workers: int = NUM_WORKERS,
    delay: int = 0,
    low: int = MIN_BUFFER,
    high: int = MAX_BUFFER,
    coefficient: float = BUFFER_COEFFICIENT,
    iterations: int = LOCAL_ITERATIONS,
    test: DataFrame | None = None,
    rate: float | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start training on ``stream`` (``shard``, ``id``, ``t_ms``, ``label``, ``features``).

    Version 0 is written before the query starts.  ``trigger`` is passed on,
    e.g. ``{"processingTime": "5 seconds"}``; the default takes what is there
    and stops.
    """
    spark = stream.sparkSession
    store = TrainingStore(spark, folder)
    if not _exists(spark, store.path("weights", 0)):
        store.start(weights, num_workers)

    def step(batch: DataFrame, number: int) -> None:
        train_batch(
            store,
            batch,
            number,
            num_workers=num_workers,
            delay=delay,
            low=low,
            high=high,
            coefficient=coefficient,
            iterations=iterations,
            test=test,
            rate=rate,
        )

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def dedupe_deltas(stream: DataFrame, event_time: str | None = None, within: str | None = None) -> DataFrame:
    """Each ``(worker, clock)`` once, whatever a retrying producer sends.

    With ``event_time`` and ``within`` state is dropped once a repeat can no
    longer come; without them it is kept for the whole run.
    """
    if event_time and within:
        return stream.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["worker", "clock"])
    return stream.dropDuplicates(["worker", "clock"])


def metrics_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that keeps metric rows under their batch number."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("sep", ";").option("header", True).csv(f"{folder}/number={number}")

    return store


def dedupe_on_events(spark: SparkSession, sf: str, workers: int) -> DataFrame:
    """Every delta is sent twice; one of each is left."""
    sent = table_stream(spark, sf, "events").select(
        (F.col("user_id") % workers).alias("worker"), F.col("event_id").alias("clock"), F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt")
    )
    folder = new_folder(spark, "deltas")
    out = dedupe_deltas(sent).select("worker", "clock").writeStream.format("parquet").option("path", f"{folder}/rows")
    out.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("worker long, clock long").parquet(f"{folder}/rows")


def train_on_embeddings(spark: SparkSession, sf: str, workers: int, delay: int, pieces: int = 5) -> DataFrame:
    """After each micro-batch, the quality of the shared weights (partition -1) and of each worker's own, with its loss."""
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = table.select(
        F.col("vec_id").alias("id"), (F.col("vec_id") * 1000).alias("t_ms"), F.col("label").cast("int").alias("label"), F.col("embedding").alias("features")
    )
    sharded = shard_rows(rows, "id", workers)
    classes, width = table.agg(F.max("label") + 1, F.max(F.size("embedding"))).first()
    folder = new_folder(spark, "training")
    test = sharded.select("label", "features").cache()

    def run(stream: DataFrame) -> StreamingQuery:
        start = np.zeros((classes, width + 1))
        return train_stream(stream, f"{folder}/run", start, num_workers=workers, delay=delay, low=16, test=test)

    replay(sharded, "id", pieces, f"{folder}/input", run)
    test.unpersist()
    metrics = TrainingStore(spark, f"{folder}/run").all_metrics()
    return metrics.select(
        F.col("number").alias("batch"),
        "scope",
        "partition",
        "vectorClock",
        F.round("loss", 6).alias("loss"),
        F.round("fMeasure", 6).alias("f1"),
        F.round("accuracy", 6).alias("accuracy"),
        F.col("numTuplesSeen").alias("seen"),
    )


def lagging_pieces(rows: DataFrame, pieces: int) -> DataFrame:
    """Add ``piece``: the rows of shard s come in every (s + 1)-th piece only, so later shards fall behind."""
    numbered = number_rows(rows, ["shard"], ["id"], "_r", start=0)
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("_size"))
    every = F.col("shard") + 1
    turns = F.floor((pieces - 1) / every) + 1
    piece = (F.floor(F.col("_r") * turns / F.col("_size")) * every).cast("long")
    return numbered.join(sizes, "shard").withColumn("piece", piece).drop("_r", "_size")


def gated_on_embeddings(spark: SparkSession, sf: str, workers: int, delay: int, pieces: int = 8) -> DataFrame:
    """Clock, version to train on (NULL while held back) and rows seen of each worker before every micro-batch, with stragglers."""
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = table.select(
        F.col("vec_id").alias("id"), (F.col("vec_id") * 1000).alias("t_ms"), F.col("label").cast("int").alias("label"), F.col("embedding").alias("features")
    )
    classes, width = table.agg(F.max("label") + 1, F.max(F.size("embedding"))).first()
    folder = new_folder(spark, "gated")

    def run(stream: DataFrame) -> StreamingQuery:
        start = np.zeros((classes, width + 1))
        return train_stream(stream.drop("piece"), f"{folder}/run", start, num_workers=workers, delay=delay, low=16, rate=0.5)

    replay(lagging_pieces(shard_rows(rows, "id", workers), pieces), "piece", pieces, f"{folder}/input", run)
    clocks = TrainingStore(spark, f"{folder}/run").all_clocks()
    return clocks.select(F.col("number").alias("batch"), "worker", "clock", "version", "seen")
