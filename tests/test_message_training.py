"""Workers over message streams, clocks of deltas, and files that follow each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_model import as_array
from tests.test_ordered import arrivals_frame, rows_of
from tests.test_streaming import labelled
from tidemark.operators import buffer, weights as model
from tidemark.plans import training as batch_training
from tidemark.sources.streams import INPUT_DATA, WEIGHTS, append_messages, write_in_order
from tidemark.storage import ship_package
from tidemark.streaming import buffer as stream_buffer, tracker, worker
from tidemark.streaming.replay import only_with_data, rocksdb_state


def numbers(r):
    return r["worker"], r["clock"]


def test_a_worker_waits_for_examples_and_trains_once_per_clock(spark, tmp_path):
    ship_package(spark)
    df = labelled(spark, n=60, shards=2)
    classes, width = df.agg(F.max("label") + 1, F.max(F.size("features"))).first()
    run = worker.MessageTraining(spark, str(tmp_path), classes, width, num_workers=2, low=4, high=12, coefficient=0.2)
    run.start(model.weights_frame(spark, np.zeros((classes, width + 1))))

    def steps():
        with rocksdb_state(spark):
            run.run().awaitTermination()
        return spark.read.schema(worker.DELTAS + ", number long").parquet(f"{tmp_path}/run/deltas").drop("number")

    early = steps()
    assert early.count() == 0  # weights came, but there is nothing to train on
    run.publish(df.filter("shard = 0"))
    first = steps()
    assert [numbers(r) for r in first.collect()] == [(0, 0)]  # the other worker still waits
    sent = spark.read.schema("key long, value string").parquet(f"{tmp_path}/{WEIGHTS}").filter("key = 0")
    append_messages(sent, WEIGHTS, str(tmp_path))  # repeats, with the weights for clock 1 if they were released
    run.publish(df.filter("shard = 1"))
    second = steps()
    got = sorted(numbers(r) for r in second.collect())
    assert got == [(0, 0), (1, 0)]  # clock 1 is released only now that both have stepped
    held = buffer.snapshot(df.drop("label", "features").withColumn("value", F.lit(0.0)), 4, 12, 0.2).select("shard", "id")
    fits = batch_training.local_fit(df.join(held, ["shard", "id"]), np.zeros((classes, width + 1)))
    for r in second.collect():
        want = as_array(fits, "delta", (classes, width + 1), r["worker"])
        flat = np.append(want[:, 1:].T.ravel(), want[:, 0])
        assert np.allclose(r["deltas"], flat, atol=1e-6)
        assert np.isclose(r["loss"], fits.filter(F.col("shard") == r["worker"]).first()["loss"])
        assert r["rows"] == held.filter(F.col("shard") == r["worker"]).count()
    local = run.local_weights()
    assert {r["version"] for r in local.select("version").distinct().collect()} == {0}
    assert spark.read.schema("key long, value string").parquet(f"{tmp_path}/{INPUT_DATA}").count() == 60


def test_files_follow_each_other(spark, tmp_path):
    _, df = arrivals_frame(spark, 5, n=500)
    files = write_in_order(df.repartition(7), ["t_ms", "id"], str(tmp_path / "in"), rows_per_file=60, least_files=3)
    assert files >= 8
    seen = []

    def note(batch, number):
        seen.append(tuple(batch.agg(F.min("t_ms"), F.max("t_ms"), F.count(F.lit(1))).first()))

    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == files and sum(n for _, _, n in seen) == 500 and max(n for _, _, n in seen) < 200
    assert all(a[1] <= b[0] for a, b in zip(seen, seen[1:]))


def test_contents_of_a_streamed_buffer(spark, tmp_path):
    """After every micro-batch the state holds what the table form says."""
    ship_package(spark)
    _, df = arrivals_frame(spark, 9, n=240)
    write_in_order(df, ["t_ms", "id"], str(tmp_path / "in"), least_files=3)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with rocksdb_state(spark):
        rows = stream_buffer.adaptive_buffer(stream, 4, 30, 0.2, history=20)
        sink = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        query = sink.trigger(availableNow=True).start()
        query.awaitTermination()
        counts = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
        assert len(counts) >= 3
        arrived = [tuple(r) for r in df.select("t_ms", "id").orderBy("t_ms", "id").collect()]
        for number in (0, len(counts) - 1):
            last = arrived[sum(counts[: number + 1]) - 1]
            so_far = df.filter((F.col("t_ms") < last[0]) | ((F.col("t_ms") == last[0]) & (F.col("id") <= last[1])))
            held = stream_buffer.buffered_rows(spark, str(tmp_path / "cp"), batch=number)
            want = buffer.snapshot(so_far, 4, 30, 0.2, history=20)
            columns = ["shard", "id", "insertion_id", "value"]
            assert rows_of(held, *columns) == rows_of(want, *columns)


def test_faulty_clocks_change_nothing(spark, tmp_path):
    ship_package(spark)
    clocks = {0: [0, 1, 1, 2, 0, 5, 3, 4], 1: [1, 0, 0, 2, 1, 2]}
    rows, want = [], []
    for w, sent in clocks.items():
        expected = 0
        for i, clock in enumerate(sent):
            rows.append((w, clock, 10 * i + w))
            want.append((w, 10 * i + w, clock, expected, None if clock == expected else "repeat" if clock < expected else "gap"))
            expected += clock == expected
    df = spark.createDataFrame(rows, "worker long, clock long, sent long")
    assert write_in_order(df, ["sent"], str(tmp_path / "in"), least_files=4) >= 3
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with rocksdb_state(spark), only_with_data(spark):
        sink = tracker.track_clocks(stream).writeStream.foreachBatch(tracker.fault_sink(str(tmp_path)))
        sink.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    good, faults = (spark.read.schema(tracker.TRACKED).parquet(f"{tmp_path}/{n}").drop("number").collect() for n in ("deltas", "faults"))
    assert sorted(map(tuple, good + faults), key=repr) == sorted(want, key=repr)
    assert all(r["fault"] is None for r in good) and all(r["fault"] for r in faults)
