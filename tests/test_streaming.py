import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import buffer, clocks, weights as model
from tidemark.plans import training as batch_training
from tidemark.streaming import buffer as stream_buffer, training
from tidemark.streaming.replay import replay, rocksdb_state
from tests.test_ordered import arrivals_frame, rows_of

LIMITS = (4, 30, 0.2)


def pieces(df, count):
    """``df`` cut into parts that follow each other in time."""
    top = df.agg(F.max("id")).first()[0] + 1
    return [df.filter((F.col("id") >= top * i // count) & (F.col("id") < top * (i + 1) // count)) for i in range(count)]


def test_stateful_buffer_over_many_batches_equals_the_table(spark, tmp_path):
    _, df = arrivals_frame(spark, 3, n=400)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in pieces(df, 4):
        part.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    with rocksdb_state(spark):
        rows = stream_buffer.adaptive_buffer(stream, *LIMITS, history=20)
        sink = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
        query = sink.trigger(availableNow=True).start()
        query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4
    got = spark.read.schema(stream_buffer.OUTPUT).parquet(out)
    want = buffer.timeline(df, *LIMITS, history=20)
    cols = ["shard", "id", "n", "target", "occupancy"]
    assert rows_of(got, *cols) == rows_of(want, *cols)
    gone = got.select("shard", F.explode(F.when(F.col("evicted_to") >= F.col("evicted_from"), F.sequence("evicted_from", "evicted_to"))).alias("i"), "n")
    left = buffer.evictions(df, *LIMITS, history=20).select("shard", F.col("insertion_id").alias("i"), F.col("evicted_by").alias("n"))
    assert rows_of(gone, "shard", "i", "n") == rows_of(left, "shard", "i", "n")


def test_buffer_carried_from_batch_to_batch_equals_the_table(spark):
    _, df = arrivals_frame(spark, 8, n=300)
    tail = None
    seen = []
    for part in pieces(df, 5):
        rows = training.advance_buffer(tail, part, *LIMITS, history=20).collect()
        tail = spark.createDataFrame(rows, "shard long, id long, t_ms long, value double, n long, floor long, released long")
        so_far = df.filter(F.col("id") <= part.agg(F.max("id")).first()[0])
        kept = tail.filter("n > released").select("shard", "id", F.col("n").alias("insertion_id"))
        assert rows_of(kept, "shard", "id", "insertion_id") == rows_of(
            buffer.snapshot(so_far, *LIMITS, history=20), "shard", "id", "insertion_id"
        )
        seen.append(kept.count())
    assert len(set(seen)) > 1


def labelled(spark, n=240, shards=3, seed=6):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(3, 4)) * 2
    y = rng.integers(0, 3, n)
    rows = [(i % shards, i, i * 1000, int(c), [float(v) for v in centre[c] + rng.normal(size=4)]) for i, c in enumerate(y)]
    return spark.createDataFrame(rows, "shard long, id long, t_ms long, label int, features array<double>")


def run_training(spark, folder, df, delay, count=3, workers=3):
    def run(stream):
        return training.train_stream(
            stream, f"{folder}/run", np.zeros((3, 5)), num_workers=workers, delay=delay, low=8, test=df.select("label", "features")
        )

    replay(df, "id", count, f"{folder}/in", run)
    return training.TrainingStore(spark, f"{folder}/run")


def test_training_on_a_stream_is_rounds_over_the_buffers(spark, tmp_path):
    df = labelled(spark)
    store = run_training(spark, str(tmp_path), df, 0)
    w = np.zeros((3, 5))
    for number in range(3):
        buffers = buffer.snapshot(df.filter(F.col("id") < 80 * (number + 1)), 8)
        w = batch_training.train_rounds(buffers, w, 1, 3)[-1]
        assert np.allclose(store.weights(number + 1), w)
        assert {c["clock"] for c in store.clocks(number + 1).values()} == {number + 1}
    metrics = store.all_metrics()
    assert metrics.count() == 3 * 4 and metrics.filter("scope = 'local' and loss <= 0").count() == 0
    shared = {r["number"]: r["fMeasure"] for r in metrics.filter("scope = 'shared'").collect()}
    assert shared[2] > 0.6


def test_sum_of_deltas_is_the_change_of_the_weights_and_replay_changes_nothing(spark, tmp_path):
    df = labelled(spark)
    store = run_training(spark, str(tmp_path), df, -1)
    deltas = spark.read.parquet(f"{store.folder}/deltas").groupBy("class", "feature").agg((F.sum("delta") / 3).alias("value"))
    assert np.allclose(model.weight_arrays(deltas), store.weights(3))
    before = [store.weights(v) for v in range(4)]
    again = training.TrainingStore(spark, store.folder)
    batch = df.filter("id >= 160")
    training.train_batch(
        again, batch, 2, num_workers=3, delay=-1, low=8, high=1024, coefficient=0.3, iterations=2, test=None
    )
    fresh = training.TrainingStore(spark, store.folder)
    assert all(np.allclose(a, fresh.weights(v)) for v, a in enumerate(before))


@pytest.mark.parametrize("delay", [0, 1, -1])
def test_straggler_holds_back_the_others_as_the_rule_says(spark, tmp_path, delay):
    df = labelled(spark).filter((F.col("shard") != 2) | (F.col("id") < 60))
    store = run_training(spark, str(tmp_path), df, delay, count=4)
    clock = {w: c["clock"] for w, c in store.clocks(4).items()}
    assert clock[2] == 1
    assert clock[0] == clock[1] == {0: 2, 1: 3, -1: 4}[delay]
    assert max(clock.values()) - min(clock.values()) <= (delay + 1 if delay >= 0 else 3)


@pytest.mark.parametrize("delay", [0, 1, 3, -1])
def test_release_in_the_driver_is_the_gate_of_the_table(spark, delay):
    rng = random.Random(delay)
    for _ in range(4):
        state = {w: {"clock": rng.randrange(5), "version": rng.choice([None, 3]), "seen": 0} for w in range(4)}
        rows = training.next_release(state, {}, {}, delay, 9)
        table = spark.createDataFrame([(w, s["clock"]) for w, s in state.items()], "worker long, clock long")
        held = spark.createDataFrame([(w,) for w, s in state.items() if s["version"] is None], "worker long")
        free = {r["worker"] for r in clocks.gate(table, held, delay).collect()}
        assert {w for w, _, v, _ in rows if v == 9} == free


def test_a_worker_without_data_does_not_step(spark, tmp_path):
    df = labelled(spark).filter("shard <> 1")
    store = run_training(spark, str(tmp_path), df, -1, count=2)
    assert store.clocks(2)[1]["clock"] == 0 and store.clocks(2)[0]["clock"] == 2


def test_repeated_deltas_are_dropped_across_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    for _ in range(2):
        spark.createDataFrame([(w, c) for w in range(3) for c in range(5)], "worker long, clock long").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("worker long, clock long").option("maxFilesPerTrigger", 1).parquet(folder)
    query = training.dedupe_deltas(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 15


def test_metrics_sink_keeps_one_copy_per_batch(spark, tmp_path):
    sink = training.metrics_sink(str(tmp_path / "m"))
    df = spark.range(3)
    sink(df, 0), sink(df, 0), sink(df, 1)
    assert spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "m")).count() == 6
