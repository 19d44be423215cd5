"""Lookups in time: the last known row at or before a moment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.ordered import Running, running


def asof(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: Sequence[str],
    take: Sequence[str],
    *,
    left_tie: str,
    right_tie: str,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Add to every left row the ``take`` columns of the latest right row with ``right.on <= left.on``.

    Both sides become one ordered list (right rows first at equal times) and
    the last right row is carried forward, so there is no join and no pair is
    ever formed.  ``left_tie`` and ``right_tie`` are unique LONG columns that
    fix the order of equal times; among equal right times the largest
    ``right_tie`` wins.  A hot group is cut into ranges.
    """
    rest = [c for c in left.columns if c not in (*by, on)]
    found = F.struct(*[F.col(c).alias(f"r{i}") for i, c in enumerate(take)])
    events = right.select(
        *by, on, F.lit(0).alias("_side"), F.col(right_tie).cast("long").alias("_tie"), found.alias("_right")
    ).unionByName(
        left.select(*by, on, F.lit(1).alias("_side"), F.col(left_tie).cast("long").alias("_tie"), F.struct(*rest).alias("_left")),
        allowMissingColumns=True,
    )
    filled = running(
        events, by, [on, "_side", "_tie"], {"_last": Running("last", F.col("_right"))}, rows_per_task=rows_per_task
    ).filter("_side = 1")
    return filled.select(
        *by, on, *[F.col(f"_left.{c}").alias(c) for c in rest], *[F.col(f"_last.r{i}").alias(c) for i, c in enumerate(take)]
    )


def weights_at_release(schedule: DataFrame, versions: DataFrame, num_workers: int, rows_per_task: int | None = None) -> DataFrame:
    """Version of the shared weights each worker was given when it was released.

    ``schedule`` has ``worker``, ``clock``, ``released_ms``; ``versions`` has
    ``released_ms`` and ``version``.  Versions belong to no worker, so each is
    copied once per worker, which keeps the lookup partitioned by worker.
    """
    workers = F.sequence(F.lit(0).cast("long"), F.lit(num_workers - 1).cast("long"))
    each = versions.select("released_ms", "version").withColumn("worker", F.explode(workers))
    return asof(
        schedule, each, "released_ms", ["worker"], ["version"], left_tie="clock", right_tie="version", rows_per_task=rows_per_task
    )
