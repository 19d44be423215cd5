"""Where intermediate tables go: the folder every executor can reach."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    A folder of our own is chosen only where none is set, and only on a local
    master, where driver and executors are one process.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
        return folder
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; Spark removes it when the session's JVM ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder; what follows starts from the copy, also after a lost executor."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    copy = df.sparkSession.read.schema(df.schema).parquet(folder)
    copy._folder = folder
    return copy


def dropped(*tables: DataFrame) -> None:
    """Remove the copies that :func:`written` made of ``tables``, once nothing that is still to run reads them.

    What was worked out from them must have been written itself, as a lost
    executor makes Spark read their files again.
    """
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._folder)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per session.

    The archive lies with the driver, whose file server hands it out; it is
    code, not data.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), os.path.basename(here))
    made = shutil.make_archive(archive, "zip", os.path.dirname(here), os.path.basename(here))
    context.addPyFile(made)
    _shipped.add(context.applicationId)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written copy."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame) -> DataFrame:
    """A join side that is used more than once: written once, and joined by its size in bytes.

    Spark knows the size of the written files, so it broadcasts the side if it
    is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise.
    """
    return written(df, "side")
