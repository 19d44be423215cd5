"""What a streamed query pays a micro-batch: few of them as the table grows, and few partitions of state."""

import glob

import pytest
from pyspark.sql import functions as F

from tests.compare import connect, differences
from tidemark.plans import fixtures as fx
from tidemark.plans.oracle import SQL
from tidemark.storage import ship_package
from tidemark.streaming import buffer as stream_buffer, timers, tracker
from tidemark.streaming.replay import only_with_data, rocksdb_state


@pytest.fixture
def many_partitions(spark):
    ship_package(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    yield
    assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    spark.conf.set("spark.sql.shuffle.partitions", before)


def batches_and_partitions(rows, kind):
    """Micro-batches of the query that wrote ``rows``, and the partitions of its state."""
    path = rows.inputFiles()[0].removeprefix("file:")
    folder = path[: path.index("/", path.index(f"/{kind}-") + 1)]
    return len(glob.glob(f"{folder}/checkpoint/commits/[0-9]*")), len(glob.glob(f"{folder}/checkpoint/state/0/[0-9]*"))


def test_tracker_takes_several_files_a_batch_and_has_few_partitions(spark, tiny, many_partitions):
    trace = fx.trace(spark, tiny).select("worker", "event_id", "clock")
    rows = tracker.tracked_events(spark, trace, fx.WORKERS, rows_per_file=50)
    batches, partitions = batches_and_partitions(rows, "tracked")
    assert 5 <= batches <= 8 and partitions == 12
    assert differences(rows, connect(tiny), SQL["stream_clock_faults"]) is None


def test_buffer_takes_several_files_a_batch_and_has_few_partitions(spark, tiny, many_partitions):
    limits = fx.LOW, fx.HIGH, fx.COEFFICIENT
    rows, held = stream_buffer.run_on_events(spark, tiny, fx.WORKERS, *limits, least_batches=4, rows_per_file=50)
    batches, partitions = batches_and_partitions(rows, "buffer")
    assert 4 <= batches <= 6 and partitions == 12
    assert differences(rows, connect(tiny), SQL["stream_adaptive_buffer"]) is None
    held = held.withColumn("value", F.round("value", 6))
    assert differences(held, connect(tiny), SQL["stream_buffer_contents"]) is None


def test_timers_take_no_more_batches_for_more_files(spark, tiny, many_partitions):
    rows = timers.timed_on_events(spark, tiny, fx.WORKERS, rows_per_file=20)
    batches, partitions = batches_and_partitions(rows, "timed")
    assert 5 <= batches <= 6 and partitions == 12
    assert sorted(tuple(r) for r in rows.select("worker", "run").collect()) == [(w, 1) for w in range(4)]


def test_a_null_worker_is_heard_of_like_the_others(spark, tmp_path):
    ship_package(spark)
    source = str(tmp_path / "in")
    for _ in range(3):
        spark.createDataFrame([(None,), (1,), (1,), (None,)], "worker long").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("worker long").option("maxFilesPerTrigger", 1).parquet(source)
    with rocksdb_state(spark, 2), only_with_data(spark):
        sink = timers.timed_runs(stream, 1).writeStream.format("parquet").option("path", str(tmp_path / "runs"))
        sink.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    runs = spark.read.schema(timers.RUNS).parquet(str(tmp_path / "runs")).select("worker", "run").collect()
    assert sorted(map(tuple, runs), key=repr) == [(1, 1), (None, 1)]
