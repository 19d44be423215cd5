"""One named query per operator over the test tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.columns import NUM_FEATURES, features_of, key_between, lookup, same_message
from tidemark.operators import buffer, clocks, lookups, ordered, prep, quality, runlog, scoring, weights as model
from tidemark.plans import fixtures as fx, training
from tidemark.plans.certificate import certificate
from tidemark.plans.fixtures import COEFFICIENT, HIGH, LOW, WORKERS, table
from tidemark.sources import examples as csv_examples, messages, runlogs, streams
from tidemark.storage import new_folder, written
from tidemark.streaming import (
    buffer as stream_buffer,
    timers as stream_timers,
    tracker as stream_tracker,
    training as stream_training,
    worker as stream_worker,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BUFFER = (LOW, HIGH, COEFFICIENT)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(c) -> F.Column:
    return F.round(c, 6)


def zeros(spark, sf) -> np.ndarray:
    return model.weight_arrays(model.init_weights_for(fx.examples(spark, sf)))


def predictions(spark, sf) -> DataFrame:
    fixed = model.weight_arrays(fx.weights(spark, sf))
    return scoring.predict(fx.examples(spark, sf), fixed, ("row_id", "shard", "label"))


# ---- flagship -------------------------------------------------------------


@query
def shared_step_quality(spark, sf):
    """One step per shard from zero weights, deltas combined, every shard's rows scored."""
    rows = fx.examples(spark, sf)
    start = zeros(spark, sf)
    deltas = scoring.gradient_step(rows, start, 1.0)
    new = model.weight_arrays(model.combine(model.weights_frame(spark, start), deltas, WORKERS))
    out = training.evaluate(rows, new, ["shard"])
    return out.select("shard", r6("f1").alias("f1"), r6("accuracy").alias("accuracy"), "rows")


# ---- sources and messages -------------------------------------------------


def _gradient_messages(spark, sf) -> DataFrame:
    rows = table(spark, sf, "events")
    user = F.col("user_id").cast("int")
    message = messages.gradient_message(
        F.col("event_id").cast("int"), user, user + 1, F.create_map(user, F.col("value")), F.col("user_id") % WORKERS
    )
    return rows.select("event_id", messages.encode(message).alias("value"))


@query
def encode_tagged_json(spark, sf):
    return _gradient_messages(spark, sf)


@query
def decode_tagged_json(spark, sf):
    g = F.col(messages.GRADIENT)
    out = messages.decode(_gradient_messages(spark, sf))
    return out.select(
        "event_id",
        "tag",
        g["vectorClock"].alias("clock"),
        g["keyRange"]["start"].alias("range_start"),
        g["keyRange"]["end"].alias("range_end"),
        F.round(lookup(g["values"], g["keyRange"]["start"]).cast("double"), 2).alias("v"),
        g["partitionKey"].alias("worker"),
    )


@query
def decode_json_field(spark, sf):
    k = messages.json_field("props", "k int")["k"]
    return table(spark, sf, "events").select("event_id", k.alias("k"))


@query
def csv_examples_round_trip(spark, sf):
    """Examples written as CSV lines and scanned back: features then label, zeros dropped."""
    folder = new_folder(spark, "csv-examples")
    fields = F.concat(F.transform("features", lambda x: x.cast("string")), F.array(F.col("label").cast("string"), F.col("row_id").cast("string")))
    fx.sparse(spark, sf).select(F.concat_ws(",", fields).alias("value")).write.text(folder)
    good, _ = prep.validate_width(csv_examples.read_lines(spark, folder, header=False), "fields", 66)
    rows = good.select(F.element_at("fields", -1).cast("long").alias("row_id"), features_of("fields").alias("fields"))
    numbers = csv_examples.to_numbers(rows, keep=("row_id",))
    return prep.long_vectors(numbers, "row_id", "label").select("row_id", "label", "feature", r6("x").alias("x"))


@query
def inferred_csv_scan(spark, sf):
    """Events written as CSV with a header and scanned back with the types found in the files."""
    folder = new_folder(spark, "csv-events")
    table(spark, sf, "events").select("event_id", "user_id", "event_type", "value").write.option("header", True).csv(folder)
    found = csv_examples.read_inferred(spark, folder)
    return found.select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), "event_type", r6("value").alias("value"))


@query
def server_log_round_trip(spark, sf):
    folder = new_folder(spark, "server-log")
    runlogs.write_server_log(fx.server_log(spark, sf), folder)
    return runlogs.read_server_log(spark, folder)


@query
def run_log_round_trip(spark, sf):
    folder = new_folder(spark, "worker-log")
    runlogs.write_worker_log(fx.worker_log(spark, sf), folder)
    return runlogs.read_worker_log(spark, folder)


@query
def message_stream_round_trip(spark, sf):
    """Messages published to a folder stream, read as a stream and published to another one."""
    folder = new_folder(spark, "streams")
    rows = _gradient_messages(spark, sf).select(F.col("event_id").alias("key"), "value")
    streams.append_messages(rows, streams.GRADIENTS, folder)
    stream = streams.read_messages(spark, streams.GRADIENTS, folder=folder)
    streams.write_messages(stream, streams.WEIGHTS, f"{folder}/checkpoint", folder=folder).awaitTermination()
    return spark.read.schema(streams.MESSAGE).parquet(f"{folder}/{streams.WEIGHTS}")


# ---- preparation ----------------------------------------------------------


@query
def sparse_encode(spark, sf):
    rows = prep.sparse_encode(fx.sparse(spark, sf), "features")
    return prep.long_vectors(rows, "row_id").select("row_id", "feature", r6("x").alias("x"))


@query
def split_label(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        "vec_id", F.concat("embedding", F.array(F.col("label").cast("float"))).alias("fields")
    )
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return prep.split_label(rows, "fields").select("vec_id", "label", F.size("features").alias("width"), r6(total).alias("total"))


@query
def validate_width(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("fields"))
    good, bad = prep.validate_width(rows, "fields", 1)
    return good.select("doc_id", F.lit(1).alias("fits")).unionByName(bad.select("doc_id", F.lit(0).alias("fits")))


@query
def round_robin_shards(spark, sf):
    return prep.shard_rows(table(spark, sf, "events"), "event_id", WORKERS).select("event_id", "shard")


@query
def assemble_vector(spark, sf):
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    rows = prep.assemble(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *cols), cols)
    array = vector_to_array("features")
    return rows.select("l_orderkey", "l_linenumber", *[r6(array[i]).alias(f"x{i}") for i in range(3)])


@query
def select_rename(spark, sf):
    out = prep.as_examples(table(spark, sf, "embeddings"), "embedding", "label", "vec_id")
    return out.select("vec_id", "label", r6(F.col("features")[0].cast("double")).alias("first"))


@query
def sorted_feature_entries(spark, sf):
    rows = prep.feature_entries(prep.sparse_encode(fx.sparse(spark, sf), "features"))
    return rows.select("row_id", F.array_join(F.transform("indices", lambda i: i.cast("string")), ",").alias("indices"))


@query
def sparse_vector(spark, sf):
    rows = fx.sparse(spark, sf)
    width = rows.agg(F.max(F.size("features"))).first()[0]
    rows = prep.to_sparse_vector(prep.sparse_encode(rows, "features"), "features", width)
    array = vector_to_array("vector")
    total = F.aggregate(array, F.lit(0.0), lambda a, x: a + x)
    filled = F.size(F.filter(array, lambda x: x != 0))
    return rows.select("row_id", filled.alias("entries"), r6(total).alias("total"))


@query
def missing_key_lookup(spark, sf):
    rows = prep.sparse_encode(fx.sparse(spark, sf), "features").withColumn("x", lookup("features", 5))
    return rows.filter("x is not null").select("row_id", r6("x").alias("x"))


def _flat(spark, sf) -> tuple[DataFrame, int]:
    """Combined weights under flat keys, and the number of keys."""
    weights, classes, width = fx.combined_weights(spark, sf)
    return model.to_flat(weights, classes, width).select("key", r6("value").alias("value")), classes * (width + 1)


@query
def key_range_half_open(spark, sf):
    """The second worker's quarter of the keys."""
    flat, keys = _flat(spark, sf)
    return prep.in_key_range(flat, "key", keys // 4, keys // 2)


@query
def key_range_closed(spark, sf):
    flat, keys = _flat(spark, sf)
    return flat.filter(key_between("key", keys // 4, keys // 2))


@query
def shard_slice(spark, sf):
    return prep.shard_slice(fx.arrivals(spark, sf), 2).select("id", "shard")


@query
def common_clock_rows(spark, sf):
    return runlog.to_common_clock(fx.worker_log(spark, sf)).select("run", "partition", "vectorClock", "numTuplesSeen")


@query
def relabel(spark, sf):
    both = runlog.union_logs(fx.server_log(spark, sf), fx.worker_log(spark, sf))
    return runlog.relabel(both, runlog.SERVER, WORKERS).select("run", "partition", "vectorClock")


@query
def tag_run(spark, sf):
    return runlog.tag_run(table(spark, sf, "events"), "night").select("event_id", "run")


@query
def cast_label(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("as_double"), F.col("label").alias("as_text"))
    return prep.cast_label(prep.cast_label(rows, "as_double", "double"), "as_text", "string")


@query
def same_message_check(spark, sf):
    """Two decoded messages per event, their values in another order; those of clicks differ."""
    k, clock = F.col("user_id").cast("int"), F.col("event_id").cast("int")
    bump = F.when(F.col("event_type") == "click", 1.0).otherwise(0.0)
    sent = table(spark, sf, "events").select(
        "event_id",
        messages.encode(messages.weights_message(clock, k, k + 1, F.create_map(k, F.col("value"), k + 1, F.lit(0.5)))).alias("a"),
        messages.encode(messages.weights_message(clock, k, k + 1, F.create_map(k + 1, F.lit(0.5), k, F.col("value") + bump))).alias("b"),
    )
    a = messages.decode(sent, "a").withColumnRenamed(messages.WEIGHTS, "_a").select("event_id", "b", "_a")
    both = messages.decode(a, "b")
    return both.select("event_id", same_message("_a", messages.WEIGHTS).cast("int").alias("same"))


@query
def hash_text(spark, sf):
    return prep.hash_text(table(spark, sf, "documents"), "text", "doc_id")


@query
def hashed_maps(spark, sf):
    """Every document's hashed term counts; a document without words keeps one row."""
    rows = prep.hashed_maps(table(spark, sf, "documents"), "text", "doc_id")
    entries = F.explode_outer(F.transform(F.map_entries("features"), lambda e: F.struct(e["key"].alias("feature"), e["value"].cast("long").alias("x"))))
    return rows.select("doc_id", entries.alias("e")).select("doc_id", "e.feature", "e.x")


@query
def hashed_vectors(spark, sf):
    rows = prep.hashed_vectors(table(spark, sf, "documents"), "text")
    total = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", total.cast("long").alias("terms"))


@query
def cap_per_label(spark, sf):
    return prep.cap_per_label(table(spark, sf, "labels"), "quality", "doc_id", 50)


@query
def preview(spark, sf):
    return prep.preview(table(spark, sf, "events"), 5, "event_id").select("event_id", "event_type")


@query
def split_train_test(spark, sf):
    train, test = prep.split(table(spark, sf, "embeddings"), "vec_id", 0.2)
    return train.select("vec_id", F.lit("train").alias("side")).unionByName(test.select("vec_id", F.lit("test").alias("side")))


@query
def label_histogram(spark, sf):
    return prep.label_histogram(table(spark, sf, "embeddings"))


# ---- weights --------------------------------------------------------------


@query
def initial_weights(spark, sf):
    return model.init_weights_for(fx.examples(spark, sf))


@query
def flat_weights(spark, sf):
    return _flat(spark, sf)[0]


@query
def flat_weights_round_trip(spark, sf):
    weights, classes, width = fx.combined_weights(spark, sf)
    back = model.from_flat(model.to_flat(weights, classes, width), classes, width)
    return back.select("class", "feature", r6("value").alias("value"))


@query
def match_delta(spark, sf):
    out = model.match_delta(fx.weights(spark, sf), fx.deltas(spark, sf))
    return out.select("arrival", "class", "feature", r6("delta").alias("delta"), r6("value").alias("value"))


def _new_values(spark, sf) -> DataFrame:
    late = fx.deltas(spark, sf)
    return late.groupBy((F.col("class") + 5).alias("class"), "feature").agg(F.max("delta").alias("value"))


@query
def weight_upsert(spark, sf):
    out = model.upsert_weights(fx.weights(spark, sf), _new_values(spark, sf))
    return out.select("class", "feature", r6("value").alias("value"))


@query
def closing_delta(spark, sf):
    out = model.closing_delta(fx.weights(spark, sf), _new_values(spark, sf))
    return out.select("class", "feature", r6("delta").alias("delta"))


@query
def combine_deltas(spark, sf):
    out = model.combine(fx.weights(spark, sf), fx.deltas(spark, sf), WORKERS)
    return out.select("class", "feature", r6("value").alias("value"))


@query
def weight_history(spark, sf):
    out = model.weight_history(fx.weights(spark, sf), fx.deltas(spark, sf), WORKERS, ["arrival"])
    return out.select("arrival", "class", "feature", r6("value").alias("value"))


@query
def key_extent(spark, sf):
    return model.key_extent(_flat(spark, sf)[0])


@query
def collect_weights(spark, sf):
    """Map per class, shown as its size and its entries in millionths."""
    maps = model.collect_weights(fx.combined_weights(spark, sf)[0])
    text = F.array_join(
        F.transform(F.map_entries("values"), lambda e: F.concat_ws(":", e["key"].cast("string"), F.round(e["value"] * 1_000_000).cast("long").cast("string"))),
        ",",
    )
    return maps.select("class", F.size("values").alias("entries"), text.alias("text"))


@query
def missing_ids(spark, sf):
    labelled = table(spark, sf, "labels")
    low, high = table(spark, sf, "documents").agg(F.min("doc_id"), F.max("doc_id")).first()
    return model.missing_ids(labelled, "doc_id", low, high)


@query
def key_difference(spark, sf):
    """Keys of the model after an upsert that brings new classes, but for those that a delta of the log touches."""
    keys = model.upsert_weights(fx.weights(spark, sf), _new_values(spark, sf)).select("class", "feature")
    return model.difference(keys, fx.deltas(spark, sf).select("class", "feature"))


# ---- scoring and quality --------------------------------------------------


@query
def margins(spark, sf):
    out = scoring.margins(fx.vectors(spark, sf), fx.weights(spark, sf))
    return out.select("row_id", "label", "class", r6("z").alias("z"))


@query
def softmax_gradient(spark, sf):
    out = scoring.softmax_gradient(fx.vectors(spark, sf), fx.weights(spark, sf), by=["shard"])
    return out.select("shard", "class", "feature", r6("gradient").alias("gradient"))


@query
def gradient_step(spark, sf):
    out = scoring.gradient_step(fx.examples(spark, sf), model.weight_arrays(fx.weights(spark, sf)), 0.5)
    return out.select("shard", "class", "feature", r6("delta").alias("delta"), r6("loss").alias("loss"), "rows")


@query
def log_loss(spark, sf):
    out = scoring.log_loss(fx.vectors(spark, sf), fx.weights(spark, sf), by=["shard"])
    return out.select("shard", r6("loss").alias("loss"))


@query
def predict(spark, sf):
    return predictions(spark, sf).select("row_id", "label", "prediction")


@query
def predict_from_margins(spark, sf):
    z = scoring.margin_arrays(fx.vectors(spark, sf), fx.weights(spark, sf))
    return z.select("row_id", "label", scoring.best_class("z").alias("prediction"))


@query
def confusion(spark, sf):
    return quality.confusion(predictions(spark, sf))


@query
def f1_accuracy(spark, sf):
    out = quality.f1_accuracy(predictions(spark, sf), ["shard"])
    return out.select("shard", r6("f1").alias("f1"), r6("accuracy").alias("accuracy"), "rows")


@query
def class_report(spark, sf):
    out = quality.class_report(predictions(spark, sf))
    return out.select("class", *[r6(m).alias(m) for m in ("precision", "recall", "f1")], "support")


@query
def evaluate_version(spark, sf):
    rows = fx.examples(spark, sf)
    out = training.evaluate(rows, model.weight_arrays(fx.weights(spark, sf)))
    return out.select(r6("f1").alias("f1"), r6("accuracy").alias("accuracy"), "rows")


# ---- buffer ---------------------------------------------------------------


@query
def arrival_gaps(spark, sf):
    return buffer.gaps(fx.arrivals(spark, sf)).select("id", "shard", "gap")


@query
def mean_gap(spark, sf):
    return buffer.mean_gap(fx.arrivals(spark, sf)).select("id", "shard", r6("mean_gap").alias("mean_gap"))


@query
def insertion_ids(spark, sf):
    return buffer.insertion_id(fx.arrivals(spark, sf)).select("id", "shard", "n")


@query
def target_size(spark, sf):
    return buffer.target_sizes(fx.arrivals(spark, sf), *BUFFER).select("id", "shard", "target")


@query
def buffer_occupancy(spark, sf):
    return buffer.occupancy(fx.arrivals(spark, sf), *BUFFER).select("id", "shard", "n", "target", "occupancy")


@query
def buffer_snapshot(spark, sf):
    return buffer.snapshot(fx.arrivals(spark, sf), *BUFFER).select("id", "shard", "insertion_id")


@query
def buffer_snapshot_as_of(spark, sf):
    rows = fx.arrivals(spark, sf)
    at = rows.agg(F.floor((F.min("t_ms") + F.max("t_ms")) / 2)).first()[0]
    return buffer.snapshot(rows, *BUFFER, at_ms=at).select("id", "shard", "insertion_id")


@query
def buffer_evictions(spark, sf):
    return buffer.evictions(fx.arrivals(spark, sf), *BUFFER)


@query
def shard_stats(spark, sf):
    return buffer.shard_stats(fx.arrivals(spark, sf), *BUFFER)


@query
def buffer_at_training(spark, sf):
    """How many rows, and which, each training run saw, and their values summed up."""
    runs = fx.trace(spark, sf).select(F.col("worker").alias("shard"), "t_ms", F.col("event_id").alias("time_id"))
    seen = buffer.buffer_summary_at(runs, fx.arrivals(spark, sf), *BUFFER, value="value")
    return seen.select("shard", "time_id", "rows", "first_id", "last_id", F.round("total", 4).alias("total"), r6("least").alias("least"), r6("greatest").alias("greatest"))


@query
def buffer_rows_at_training(spark, sf):
    """The rows of each training run's buffer, counted and summed from the rows themselves."""
    runs = fx.trace(spark, sf).select(F.col("worker").alias("shard"), "t_ms", F.col("event_id").alias("time_id"))
    seen = buffer.buffer_at(runs, fx.arrivals(spark, sf), *BUFFER, payload=("value",))
    return seen.groupBy("shard", "time_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("insertion_id").alias("first_id"),
        F.max("insertion_id").alias("last_id"),
        F.round(F.sum("value"), 4).alias("total"),
    )


@query
def arrival_rate(spark, sf):
    return buffer.arrival_rate(fx.arrivals(spark, sf), minutes=60)


# ---- clocks ---------------------------------------------------------------


@query
def worker_clock(spark, sf):
    return fx.trace(spark, sf).select("event_id", "worker", "clock")


@query
def clock_faults(spark, sf):
    """Recorded clocks are off for every worker's late rows: they count errors twice."""
    rows = fx.trace(spark, sf).select("event_id", "worker", "t_ms", F.floor(F.col("clock") / 2 + F.col("clock") % 2).alias("recorded_clock"))
    return clocks.clock_faults(rows, ["t_ms", "event_id"]).select("event_id", "worker", "recorded_clock", "clock")


@query
def slowest_clock(spark, sf):
    return clocks.slowest_clock(fx.trace(spark, sf))


@query
def round_completion(spark, sf):
    return clocks.round_completion(fx.trace(spark, sf), WORKERS)


@query
def release_schedule_sequential(spark, sf):
    return clocks.release_schedule(fx.trace(spark, sf), WORKERS, 0)


@query
def release_schedule_eventual(spark, sf):
    return clocks.release_schedule(fx.trace(spark, sf), WORKERS, -1)


@query
def release_schedule_bounded(spark, sf):
    return clocks.release_schedule(fx.trace(spark, sf), WORKERS, 10)


@query
def wait_times(spark, sf):
    out = clocks.wait_times(clocks.release_schedule(fx.trace(spark, sf), WORKERS, 0))
    return out.withColumn("straggler_share", r6("straggler_share"))


@query
def clock_gap(spark, sf):
    return clocks.clock_gap(fx.trace(spark, sf), WORKERS)


@query
def delay_violations(spark, sf):
    return clocks.violations(fx.trace(spark, sf), WORKERS, 10).select("worker", "clock", "gap")


@query
def iteration_overlap(spark, sf):
    log = fx.trace(spark, sf).select("worker", "clock", F.col("event_id").alias("rows_seen"))
    return clocks.iteration_overlap(log)


@query
def weights_at_release(spark, sf):
    run = fx.trace(spark, sf)
    versions = clocks.round_completion(run, WORKERS).select(
        F.col("completed_ms").alias("released_ms"), (F.col("clock") + 1).alias("version")
    )
    schedule = clocks.release_schedule(run, WORKERS, 10)
    out = lookups.weights_at_release(schedule, versions, WORKERS)
    return out.select("worker", "clock", "released_ms", "version")


@query
def distinct_workers(spark, sf):
    return fx.trace(spark, sf).select("worker").distinct()


# ---- run logs -------------------------------------------------------------


@query
def common_clock(spark, sf):
    return runlog.common_clock(fx.worker_log(spark, sf))


@query
def rows_seen(spark, sf):
    return runlog.rows_seen(fx.worker_log(spark, sf))


@query
def attach_rows_seen(spark, sf):
    out = runlog.attach_rows_seen(fx.server_log(spark, sf), fx.worker_log(spark, sf))
    return out.select("run", "vectorClock", "timestamp", "total_seen")


@query
def comparable_extent(spark, sf):
    return runlog.comparable_extent(runlog.rows_seen(fx.worker_log(spark, sf)))


@query
def metric_series(spark, sf):
    out = runlog.series(fx.worker_log(spark, sf), ["loss", "fMeasure"], range(WORKERS))
    return out.select("run", "vectorClock", *[r6(f"{m}{p}").alias(f"{m}{p}") for m in ("loss", "fMeasure") for p in range(WORKERS)])


@query
def run_report(spark, sf):
    metrics = ["loss", "fMeasure", "accuracy"]
    out = runlog.report(fx.server_log(spark, sf), fx.worker_log(spark, sf), metrics, WORKERS)
    columns = [r6(f"{m}{p}").alias(f"{m}{p}") for m in metrics for p in range(WORKERS + 1)]
    return out.select("run", "vectorClock", "total_seen", *columns)


@query
def union_logs(spark, sf):
    out = runlog.union_logs(fx.server_log(spark, sf), fx.worker_log(spark, sf))
    return out.select("run", "partition", "vectorClock", "loss", "numTuplesSeen")


@query
def union_runs(spark, sf):
    log = fx.worker_log(spark, sf).drop("run")
    out = runlog.union_runs(early=log.filter("numTuplesSeen < 500"), late=log.filter("numTuplesSeen >= 500"))
    return out.select("run", "partition", "numTuplesSeen")


@query
def latest_per_worker(spark, sf):
    out = runlog.latest(fx.worker_log(spark, sf), ["run", "partition"], ["vectorClock"])
    return out.select("run", "partition", "vectorClock", "numTuplesSeen")


@query
def log_by_clock(spark, sf):
    return runlog.by_clock(fx.worker_log(spark, sf)).select("run", "partition", "vectorClock")


@query
def oldest_rows(spark, sf):
    return ordered.first_rows(buffer.insertion_id(fx.arrivals(spark, sf)), ["shard"], ["n"], 20).select("shard", "id", "n")


@query
def arg_extremes(spark, sf):
    return runlog.arg_extremes(fx.arrivals(spark, sf), ["shard"], "value", "id")


# ---- training -------------------------------------------------------------


def _rounds(spark, sf, rounds) -> list[np.ndarray]:
    return training.train_rounds(fx.examples(spark, sf), zeros(spark, sf), rounds, WORKERS, rate=2.0)


@query
def train_one_round(spark, sf):
    out = model.weights_frame(spark, _rounds(spark, sf, 1)[-1])
    return out.select("class", "feature", r6("value").alias("value"))


@query
def train_two_rounds(spark, sf):
    out = model.weights_frame(spark, _rounds(spark, sf, 2)[-1])
    return out.select("class", "feature", r6("value").alias("value"))


@query
def learning_curve(spark, sf):
    out = training.learning_curve(fx.examples(spark, sf), dict(enumerate(_rounds(spark, sf, 2))))
    return out.select("version", r6("f1").alias("f1"), r6("accuracy").alias("accuracy"), "rows")


@query
def local_fit(spark, sf):
    """Delta and loss of each worker after two L-BFGS steps from zero weights."""
    out = training.local_fit(fx.examples(spark, sf), zeros(spark, sf))
    return out.select("shard", "class", "feature", r6("delta").alias("delta"), r6("loss").alias("loss"), "rows")


@query
def local_fit_rounds(spark, sf):
    """Quality after each of three rounds of local fits."""
    rows = fx.examples(spark, sf)
    history = training.train_rounds(rows, zeros(spark, sf), 3, WORKERS)
    out = training.learning_curve(rows, dict(enumerate(history)))
    return out.select("version", r6("f1").alias("f1"), r6("accuracy").alias("accuracy"), "rows")


@query
def text_rounds(spark, sf):
    """Texts hashed to 1,024 features, dealt out to workers, and two rounds of local fits on them."""
    docs = fx.documents(spark, sf)
    hashed = prep.hashed_maps(docs, "text", "doc_id").join(docs.select("doc_id", F.col("quality").alias("label")), "doc_id")
    rows = written(prep.shard_rows(hashed, "doc_id", WORKERS), "texts")
    history = training.train_rounds(rows, np.zeros((2, NUM_FEATURES + 1)), 2, WORKERS)
    out = training.learning_curve(rows, dict(enumerate(history)))
    return out.select("version", r6("f1").alias("f1"), r6("accuracy").alias("accuracy"), "rows")


@query
def reference_model(spark, sf):
    rows = fx.examples(spark, sf)
    scored = training.reference_predictions(training.reference_model(rows, maxIter=20), rows)
    return quality.f1_accuracy(scored).select(r6("f1").alias("f1"), r6("accuracy").alias("accuracy"), "rows")


@query
def reference_certificate(spark, sf):
    """The library's model under a penalty, its objective and the lower bound that proves it the best there is."""
    penalty = 0.1
    fitted = training.reference_model(fx.examples(spark, sf), regParam=penalty, standardization=False, maxIter=500, tol=1e-8)
    out = certificate(fx.vectors(spark, sf), training.reference_weights(spark, fitted), penalty)
    return out.select(
        "rows", F.round("objective", 4).alias("objective"), F.round("lower_bound", 4).alias("lower_bound"), (F.col("gap") < 1e-5).alias("optimal")
    )


# ---- streams --------------------------------------------------------------


@query
def stream_adaptive_buffer(spark, sf):
    """`events` read as a stream of ten micro-batches or more; what the stateful buffer did at each arrival."""
    return stream_buffer.run_on_events(spark, sf, WORKERS, *BUFFER)[0]


@query
def stream_buffer_contents(spark, sf):
    """What the stateful buffer holds after all micro-batches, read from the stream's own state."""
    held = stream_buffer.run_on_events(spark, sf, WORKERS, *BUFFER)[1]
    return held.select("id", "shard", "insertion_id", r6("value").alias("value"))


@query
def stream_arrival_rate(spark, sf):
    return stream_buffer.rate_on_events(spark, sf, WORKERS, minutes=60)


@query
def stream_deduped_deltas(spark, sf):
    return stream_training.dedupe_on_events(spark, sf, WORKERS)


@query
def stream_clock_faults(spark, sf):
    """A run with repeated and leaping deltas: what the tracker took and what it put aside."""
    return stream_tracker.tracked_events(spark, fx.trace(spark, sf).select("worker", "event_id", "clock"), WORKERS)


@query
def stream_start_timer(spark, sf):
    """Each worker's one-shot timer: it fires once, not before it is due, however many messages follow."""
    fired = stream_timers.timed_on_events(spark, sf, WORKERS)
    return fired.select("worker", "run", (F.col("fired_ms") >= F.col("due_ms")).alias("due"), (F.col("due_ms") - F.col("registered_ms")).alias("after_ms"))


@query
def stream_training_sequential(spark, sf):
    return stream_training.train_on_embeddings(spark, sf, WORKERS, delay=0)


@query
def stream_training_bounded(spark, sf):
    return stream_training.train_on_embeddings(spark, sf, WORKERS, delay=2)


@query
def stream_training_eventual(spark, sf):
    return stream_training.train_on_embeddings(spark, sf, WORKERS, delay=-1)


@query
def stream_gate_sequential(spark, sf):
    return stream_training.gated_on_embeddings(spark, sf, WORKERS, delay=0)


@query
def stream_gate_bounded(spark, sf):
    return stream_training.gated_on_embeddings(spark, sf, WORKERS, delay=1)


@query
def stream_gate_eventual(spark, sf):
    return stream_training.gated_on_embeddings(spark, sf, WORKERS, delay=-1)


def _message_run(spark, sf, **worker) -> DataFrame:
    """Four pieces of `embeddings` as messages; gaps between arrivals grow, so the buffers shrink."""
    arrived = F.col("row_id") * F.col("row_id") * 10
    rows = fx.examples(spark, sf).select("shard", F.col("row_id").alias("id"), arrived.alias("t_ms"), "label", "features")
    start = model.init_weights_for(fx.examples(spark, sf)).select("class", "feature", "value")
    classes, width = start.agg(F.max("class") + 1, F.max("feature") + 1).first()
    folder = new_folder(spark, "messages")
    run = stream_worker.MessageTraining(spark, folder, classes, width, num_workers=WORKERS, low=LOW, high=HIGH, coefficient=5.0, **worker)
    out = stream_worker.train_on_messages(rows, "id", 4, folder, run, start)
    return out.select("worker", "clock", "version", r6("loss").alias("loss"), "rows", "class", "feature", r6("value").alias("value"))


@query
def stream_worker_steps(spark, sf):
    """Workers and server that talk in messages: version, local loss and local weights by worker and clock, gradient steps."""
    return _message_run(spark, sf, rate=0.5)


@query
def stream_worker_fits(spark, sf):
    """The same with local fits."""
    return _message_run(spark, sf)


@query
def gate(spark, sf):
    """Workers that may step now under a delay of 10, all with pending data."""
    now = clocks.next_clocks(fx.trace(spark, sf)).withColumnRenamed("next_clock", "clock")
    return clocks.gate(now, now, 10).select("worker", "clock")
