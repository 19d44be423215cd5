"""Analysis of run logs: ``partition`` -1 is the server, others are workers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidemark.storage import small_side

SERVER = -1


def tag_run(log: DataFrame, run: str | int) -> DataFrame:
    """Mark every row with the run it came from."""
    return log.withColumn("run", F.lit(run))


def union_logs(*logs: DataFrame) -> DataFrame:
    """Logs one below the other; columns a log lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)


def union_runs(**runs: DataFrame) -> DataFrame:
    """Logs of several runs, each tagged with its name."""
    return union_logs(*[tag_run(log, name) for name, log in runs.items()])


def relabel(log: DataFrame, old: int, new: int, column: str = "partition") -> DataFrame:
    """Replace one value of a column."""
    return log.withColumn(column, F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column)))


def common_clock(log: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Largest clock that every partition of a run has reached."""
    last = log.groupBy(*by, "partition").agg(F.max("vectorClock").alias("_last"))
    return last.groupBy(*by).agg(F.min("_last").alias("common_clock"))


def to_common_clock(log: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Rows up to the common clock of their run."""
    limits = small_side(common_clock(log, by))
    if not by:
        return log.filter(F.col("vectorClock") <= F.lit(limits.first()[0]))
    return log.join(limits, list(by)).filter(F.col("vectorClock") <= F.col("common_clock")).drop("common_clock")


def rows_seen(log: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Rows seen by all workers of a run at each clock."""
    workers = log.filter(F.col("partition") != SERVER)
    return workers.groupBy(*by, "vectorClock").agg(F.sum("numTuplesSeen").alias("total_seen"))


def attach_rows_seen(server: DataFrame, worker: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Server rows with the rows all workers had seen at their clock; NULL where no worker logged it."""
    return server.join(rows_seen(worker, by), [*by, "vectorClock"], "left")


def comparable_extent(log: DataFrame, column: str = "total_seen") -> DataFrame:
    """Rows seen up to which all runs can be compared."""
    return log.groupBy("run").agg(F.max(column).alias("_most")).agg(F.min("_most").alias("extent"))


def series(log: DataFrame, metrics: Sequence[str], partitions: Sequence[int], by: Sequence[str] = ("run",)) -> DataFrame:
    """One row per clock with one column per metric and partition, ready to plot.

    The partitions are named, so no extra pass looks for them.
    """
    columns = [
        F.max(F.when(F.col("partition") == p, F.col(m))).alias(f"{m}{p}") for m in metrics for p in partitions
    ]
    return log.groupBy(*by, "vectorClock").agg(*columns)


def report(server: DataFrame, worker: DataFrame, metrics: Sequence[str], num_workers: int) -> DataFrame:
    """Series of several runs that can be compared, in one plan.

    Both logs up to the common clock of each run, one column per metric and
    worker (the server is worker ``num_workers``), the rows seen by all workers
    at each clock, up to the rows seen that every run reached.
    """
    kept = to_common_clock(union_logs(server, worker))
    totals = rows_seen(kept)
    lines = series(relabel(kept, SERVER, num_workers), metrics, range(num_workers + 1))
    return lines.join(totals, ["run", "vectorClock"]).filter(F.col("total_seen") <= comparable_extent(totals).scalar())


def latest(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of every group, reduced in each task before the shuffle."""
    rest = [c for c in df.columns if c not in by]
    last = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return last.select(*[F.col(c) if c in by else F.col(f"_row.{c}").alias(c) for c in df.columns])


def by_clock(log: DataFrame) -> DataFrame:
    """Rows in clock order, partitions in order within a clock."""
    return log.orderBy("vectorClock", "partition")


def arg_extremes(df: DataFrame, by: Sequence[str], value: str, row: str) -> DataFrame:
    """Row id at the smallest and at the largest value; the lowest id on a tie."""
    return df.groupBy(*by).agg(
        F.min(F.struct(F.col(value), F.col(row)))[row].alias("arg_min"),
        F.max_by(F.col(row), F.struct(F.col(value), -F.col(row))).alias("arg_max"),
    )
