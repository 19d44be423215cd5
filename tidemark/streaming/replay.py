"""Turning a table into a stream and a finished stream back into a table."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
PARTITIONS_PER_KEY = 3


@contextmanager
def rocksdb_state(spark: SparkSession, keys: int | None = None):
    """Keep operator state in RocksDB, off the heap, for queries started inside.

    Each micro-batch pays for every partition of the state, empty ones too: a
    Python worker, a store and its commit.  Where an operator has few ``keys``,
    give their number: it gets three partitions for each, so that few keys
    meet in one, and never more than the session sets.
    """
    before, partitions = spark.conf.get(PROVIDER, None), spark.conf.get(PARTITIONS)
    spark.conf.set(PROVIDER, ROCKSDB)
    if keys is not None:
        spark.conf.set(PARTITIONS, min(int(partitions), PARTITIONS_PER_KEY * keys))
    try:
        yield
    finally:
        spark.conf.set(PARTITIONS, partitions)
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


@contextmanager
def only_with_data(spark: SparkSession):
    """Queries started inside run no micro-batch without rows.

    An operator with processing time would run such batches for ever, so a
    query that is to stop by itself needs this.
    """
    before = spark.conf.get(NO_DATA, None)
    spark.conf.set(NO_DATA, "false")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(NO_DATA)
        else:
            spark.conf.set(NO_DATA, before)


def table_stream(spark: SparkSession, folder: str, name: str, max_files: int | None = None) -> DataFrame:
    """The parquet table ``name`` of ``folder`` as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def replay(rows: DataFrame, order: str, pieces: int, folder: str, run: Callable[[DataFrame], StreamingQuery]) -> None:
    """Feed ``rows`` to a stream piece by piece in ``order``; every row is in one piece.

    After each piece lands, ``run`` starts a query over everything in
    ``folder`` that takes what is new and stops; its checkpoint carries it on,
    so each piece is one micro-batch.
    """
    low, high = rows.agg(F.min(order), F.max(order)).first()
    width = (high - low) // pieces + 1
    for piece in range(pieces):
        start = low + piece * width
        rows.filter((F.col(order) >= start) & (F.col(order) < start + width)).write.mode("append").parquet(folder)
        run(rows.sparkSession.readStream.schema(rows.schema).parquet(folder)).awaitTermination()
