"""Shapes in which the named queries use the test tables; each grows with its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.columns import epoch_ms
from tidemark.operators.clocks import worker_clock
from tidemark.operators.ordered import number_rows
from tidemark.operators.prep import long_vectors, shard_rows
from tidemark.operators.runlog import SERVER
from tidemark.operators.weights import combine, init_weights_for

WORKERS = 4
# Small bounds and a large coefficient make the buffer size vary on `events`,
# whose rows are minutes apart.
LOW, HIGH, COEFFICIENT = 8, 64, 600.0000238418579


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), epoch_ms("ts").alias("t_ms"), "value")
    return shard_rows(rows, "id", WORKERS)


def deltas(spark: SparkSession, sf: str) -> DataFrame:
    """A delta log: one model key per event."""
    return table(spark, sf, "events").select(
        (F.col("user_id") % WORKERS).alias("worker"),
        epoch_ms("ts").alias("t_ms"),
        F.col("event_id").alias("arrival"),
        (F.col("event_id") % 10).cast("int").alias("class"),
        (F.col("user_id") % 65 - 1).cast("int").alias("feature"),
        (F.col("value") / 100).alias("delta"),
    )


def trace(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % WORKERS).alias("worker"), epoch_ms("ts").alias("t_ms")
    )
    return worker_clock(rows, ["t_ms", "event_id"])


def examples(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), "label", F.col("embedding").alias("features")
    )
    return shard_rows(rows, "row_id", WORKERS)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return long_vectors(examples(spark, sf), "row_id", "shard", "label", bias=True)


def sparse(spark: SparkSession, sf: str) -> DataFrame:
    """Examples whose small entries are zero."""
    small = F.transform("features", lambda x: F.when(F.abs(x.cast("double")) < 0.1, F.lit(0.0)).otherwise(x.cast("double")))
    return examples(spark, sf).withColumn("features", small)


def weights(spark: SparkSession, sf: str) -> DataFrame:
    """Non-trivial weights for the classes and features of ``embeddings``."""
    value = ((F.col("class") * 7 + (F.col("feature") + 1) * 3) % 11 - 5) / 10.0
    return init_weights_for(examples(spark, sf)).withColumn("value", value)


def combined_weights(spark: SparkSession, sf: str) -> tuple[DataFrame, int, int]:
    """The weights that all deltas of the log add up to, with the classes and the width of the examples."""
    zero = init_weights_for(examples(spark, sf))
    classes, width = zero.agg(F.max("class") + 1, F.max("feature") + 1).first()
    return combine(zero, deltas(spark, sf), WORKERS), classes, width


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")


def worker_log(spark: SparkSession, sf: str) -> DataFrame:
    """A worker log per event type: the workers' clocks run at their own pace."""
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("run"),
        (F.col("user_id") % WORKERS).cast("int").alias("partition"),
        epoch_ms("ts").alias("timestamp"),
        F.col("value").alias("loss"),
        (F.col("value") / 1000).alias("fMeasure"),
        (F.col("value") / 500).alias("accuracy"),
        F.col("event_id").alias("numTuplesSeen"),
    )
    return number_rows(rows, ["run", "partition"], ["timestamp", "numTuplesSeen"], "vectorClock", start=0)


def server_log(spark: SparkSession, sf: str) -> DataFrame:
    """Server rows: one per delta of worker 0, without a loss or a row count."""
    log = worker_log(spark, sf).filter("partition = 0").drop("numTuplesSeen")
    return log.withColumns({"partition": F.lit(SERVER), "loss": F.lit(-1.0)})
