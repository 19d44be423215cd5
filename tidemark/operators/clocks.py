"""Clocks, release rules and stragglers of a recorded run.

Input is a ``trace`` with one row per delta that reached the server:
``worker``, ``clock`` (0, 1, 2 ... per worker) and ``t_ms``.  ``delay`` is the
consistency rule: 0 lets all workers step together, k > 0 lets a worker be k
clocks ahead of the slowest, -1 never holds a worker back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.lookups import asof
from tidemark.operators.ordered import number_rows

EVENTUAL = -1


def worker_clock(deltas: DataFrame, order: list[str], **options) -> DataFrame:
    """The clock each delta should carry: its place in the worker's arrivals, from 0."""
    return number_rows(deltas, ["worker"], order, "clock", start=0, **options)


def clock_faults(deltas: DataFrame, order: list[str], clock: str = "recorded_clock", **options) -> DataFrame:
    """Deltas whose recorded clock is not the one expected at that point."""
    return worker_clock(deltas, order, **options).filter(~F.col(clock).eqNullSafe(F.col("clock")))


def next_clocks(trace: DataFrame) -> DataFrame:
    """Clock every worker works on now."""
    return trace.groupBy("worker").agg((F.max("clock") + 1).alias("next_clock"))


def slowest_clock(trace: DataFrame) -> DataFrame:
    """Smallest clock any worker still works on."""
    return next_clocks(trace).agg(F.min("next_clock").alias("slowest_clock"))


def round_completion(trace: DataFrame, num_workers: int) -> DataFrame:
    """When the last of all workers delivered a clock; clocks not yet complete are left out.

    A group is one clock, at most one row per worker.
    """
    rounds = trace.groupBy("clock").agg(F.max("t_ms").alias("completed_ms"), F.count_distinct("worker").alias("_workers"))
    return rounds.filter(F.col("_workers") == num_workers).drop("_workers")


def release_schedule(trace: DataFrame, num_workers: int, delay: int) -> DataFrame:
    """When a worker may start its next clock under ``delay``.

    Clock 0 starts with the run and is not listed.  NULL means: held back to
    the end of the trace.  On a trace recorded under another rule the times
    are a lower bound, since later deltas would have moved too.
    """
    delivered = trace.select("worker", (F.col("clock") + 1).alias("clock"), F.col("t_ms").alias("arrived_ms"))
    if delay == EVENTUAL:
        return delivered.withColumn("released_ms", F.col("arrived_ms"))
    done = round_completion(trace, num_workers).select((F.col("clock") + delay + 1).alias("_clock"), "completed_ms")
    joined = delivered.join(done, F.col("clock") == F.col("_clock"), "left")
    released = (
        F.when(F.col("clock") <= delay, F.col("arrived_ms"))
        .when(F.col("completed_ms").isNotNull(), F.greatest("arrived_ms", "completed_ms"))
    )
    return joined.select("worker", "clock", "arrived_ms", released.alias("released_ms"))


def wait_times(schedule: DataFrame) -> DataFrame:
    """Waiting per worker, and the share of releases at which the worker did not wait (it was the straggler)."""
    wait = F.col("released_ms") - F.col("arrived_ms")
    return schedule.groupBy("worker").agg(
        F.count("released_ms").alias("releases"),
        F.coalesce(F.sum(wait), F.lit(0)).alias("waited_ms"),
        F.coalesce(F.max(wait), F.lit(0)).alias("longest_ms"),
        F.avg(F.when(wait == 0, 1.0).when(wait > 0, 0.0)).alias("straggler_share"),
        F.count(F.when(F.col("released_ms").isNull(), 1)).alias("held_back"),
    )


def clock_gap(trace: DataFrame, num_workers: int, rows_per_task: int | None = None) -> DataFrame:
    """How far a worker is ahead of the slowest one at each of its deltas.

    The slowest clock is the number of complete rounds, so it is looked up in
    the completion times, copied once per worker.
    """
    workers = F.sequence(F.lit(0).cast("long"), F.lit(num_workers - 1).cast("long"))
    done = round_completion(trace, num_workers).select(
        F.col("completed_ms").alias("t_ms"), (F.col("clock") + 1).alias("_complete"), F.explode(workers).alias("worker")
    )
    seen = asof(trace, done, "t_ms", ["worker"], ["_complete"], left_tie="clock", right_tie="_complete", rows_per_task=rows_per_task)
    own = F.col("clock") + 1
    slowest = F.coalesce(F.col("_complete"), F.lit(0)).cast("long")
    return seen.select("worker", "clock", "t_ms", slowest.alias("slowest_clock"), (own - slowest).alias("gap"))


def violations(trace: DataFrame, num_workers: int, delay: int, rows_per_task: int | None = None) -> DataFrame:
    """Deltas the rule would not have allowed.

    A delta for clock c can only follow a release at a time when the slowest
    worker was at most ``delay`` behind, so its worker may be ``delay + 1``
    ahead right after delivering.
    """
    gap = clock_gap(trace, num_workers, rows_per_task)
    return gap.filter(F.lit(delay != EVENTUAL) & (F.col("gap") > delay + 1))


def iteration_spans(log: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Each iteration of each worker as ``[start, end)`` in rows seen by the worker.

    The end is the start of the worker's next clock; the last iteration is open
    and left out.
    """
    following = log.select(
        "worker", (F.col("clock") - 1).alias("clock"), F.col("rows_seen").alias("end")
    )
    return log.select("worker", "clock", F.col("rows_seen").alias("start")).join(following, ["worker", "clock"])


def iteration_overlap(log: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Per clock: its span over all workers, the rows it shares with the next clock, and how many later clocks it reaches.

    Workers are first reduced to one span per clock.  Starts grow with the
    clock, so the later clocks a span reaches end at the last one that starts
    before the span does; that one is looked up, and no pair of spans is formed.
    """
    spans = iteration_spans(log).groupBy("clock").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    starts = spans.select((F.col("start") + 1).alias("end"), F.col("clock").alias("_reached"))
    reached = asof(spans, starts, "end", [], ["_reached"], left_tie="clock", right_tie="_reached", rows_per_task=rows_per_task)
    following = spans.select((F.col("clock") - 1).alias("clock"), F.col("start").alias("_next"))
    return reached.join(following, "clock", "left").select(
        "clock",
        "start",
        "end",
        F.greatest(F.lit(0), F.coalesce(F.col("end") - F.col("_next"), F.lit(0))).cast("long").alias("shared_with_next"),
        F.greatest(F.lit(0), F.coalesce(F.col("_reached"), F.col("clock")) - F.col("clock")).cast("long").alias("later_clocks"),
    )


def lets_go(clock, slowest, delay: int):
    """The release rule itself, on numbers or on columns."""
    return clock - slowest <= delay if delay != EVENTUAL else clock == clock


def gate(clocks: DataFrame, pending: DataFrame, delay: int) -> DataFrame:
    """Workers with pending data that may step now.

    ``clocks`` (``worker``, ``clock``) has one row per worker, ``clock`` being
    the one it works on next; ``pending`` lists workers with data.
    """
    waiting = clocks.join(pending.select("worker").distinct(), "worker", "left_semi")
    return waiting.filter(lets_go(F.col("clock"), clocks.agg(F.min("clock")).scalar(), delay))
