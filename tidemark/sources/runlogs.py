"""Run logs: ``;``-separated CSV with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

# Field names of the log format.
SERVER_LOG = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("vectorClock", T.IntegerType()),
        T.StructField("loss", T.DoubleType()),
        T.StructField("fMeasure", T.DoubleType()),
        T.StructField("accuracy", T.DoubleType()),
    ]
)
WORKER_LOG = T.StructType([*SERVER_LOG.fields, T.StructField("numTuplesSeen", T.LongType())])


def read_server_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SERVER_LOG).csv(path, sep=";", header=True)


def read_worker_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WORKER_LOG).csv(path, sep=";", header=True)


def write_server_log(log: DataFrame, path: str, mode: str = "append") -> None:
    log.select(*SERVER_LOG.names).write.mode(mode).csv(path, sep=";", header=True)


def write_worker_log(log: DataFrame, path: str, mode: str = "append") -> None:
    log.select(*WORKER_LOG.names).write.mode(mode).csv(path, sep=";", header=True)
