"""Keyed message streams: Kafka where its connector is installed, files elsewhere.

Both have the schema ``key LONG, value STRING``.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

MESSAGE = "key long, value string"

# Names of the three streams.
INPUT_DATA, WEIGHTS, GRADIENTS = "INPUT_DATA", "WEIGHTS_TOPIC", "GRADIENTS_TOPIC"


def read_messages(
    spark: SparkSession,
    name: str,
    *,
    servers: str | None = None,
    folder: str | None = None,
    max_per_trigger: int | None = None,
) -> DataFrame:
    """Stream ``name`` from its earliest record on.

    ``max_per_trigger`` bounds a micro-batch: offsets for Kafka, files for a
    folder.
    """
    if servers is not None:
        reader = (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("subscribe", name)
            .option("startingOffsets", "earliest")
        )
        if max_per_trigger is not None:
            reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
        # Keys are signed 8-byte big-endian integers.
        key = F.conv(F.hex("key"), 16, -10).cast("long")
        return reader.load().select(key.alias("key"), F.col("value").cast("string").alias("value"))
    reader = spark.readStream.schema(MESSAGE)
    if max_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_per_trigger)
    return reader.parquet(f"{folder}/{name}")


def write_messages(
    messages: DataFrame,
    name: str,
    checkpoint: str,
    *,
    servers: str | None = None,
    folder: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Publish ``key``, ``value`` to stream ``name``; ``trigger`` as for ``DataStreamWriter.trigger``."""
    writer = messages.select(F.col("key").cast("long").alias("key"), "value").writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    if servers is not None:
        binary = messages.select(F.unhex(F.lpad(F.hex("key"), 16, "0")).alias("key"), "value")
        writer = binary.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
        return writer.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", name).start()
    return writer.format("parquet").option("path", f"{folder}/{name}").start()


def write_in_order(rows: DataFrame, order: list[str], folder: str, rows_per_file: int = 250_000, least_files: int = 1) -> int:
    """Write ``rows`` as files that follow each other in ``order``; the number of files.

    A file stream takes files by age, so with ``maxFilesPerTrigger`` its
    micro-batches follow the order and none holds more than that many files:
    the rows of one key are never together in one task but for these.  Files get
    their place by their time of change, one second apart, so the store has to
    keep such times.
    """
    files = max(least_files, math.ceil(rows.count() / rows_per_file))
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(folder)
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(str(f.getPath()) for f in store.listStatus(path) if f.getPath().getName().startswith("part-"))
    first = int(time.time() - len(names)) * 1000
    for place, name in enumerate(names):
        file = spark._jvm.org.apache.hadoop.fs.Path(name)
        store.setTimes(file, first + 1000 * place, -1)
        if store.getFileStatus(file).getModificationTime() != first + 1000 * place:
            raise RuntimeError(f"{folder} does not keep the times of files")
    return len(names)


def files_at_once(files: int, least_batches: int, most: int | None = 4) -> int:
    """``maxFilesPerTrigger`` for files of :func:`write_in_order`: as many as leave ``least_batches`` micro-batches, up to ``most``.

    A micro-batch has its own costs, so it takes several files where there are
    many; ``most`` bounds the rows of one key that a task holds.  Without
    ``most`` the number of micro-batches stays the same as the table grows,
    for operators that hold no rows.
    """
    fit = max(1, files // least_batches)
    return fit if most is None else min(most, fit)


def append_messages(messages: DataFrame, name: str, folder: str) -> None:
    """Publish a finite set of messages to a folder stream."""
    messages.select(F.col("key").cast("long").alias("key"), "value").write.mode("append").parquet(f"{folder}/{name}")
