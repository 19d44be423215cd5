"""Ranks and running sums over rows in a global order, with DataFrame operations only.

A window without a partition key, or one over a source that holds a third of
all rows, is one task.  Here the rows are dealt out by range, every range gives
one row of totals, and what the earlier ranges carry is added to the window
inside each range.  The dealt rows are written to the shared folder, so a
retried task sees the same ranges.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tidemark.storage import written


def running_totals(rows: DataFrame, group: Sequence[str], order: Sequence[str], values: Sequence[str] = ()) -> DataFrame:
    """Add to narrow ``rows``, per ``group`` in ``order`` (nulls first):

    ``rank`` (rows before), ``group_rows``, and for each of ``values``
    ``before_<v>`` (its sum over the rows before) and ``total_<v>``.  A null
    group is a group.  Rows equal in ``group`` and ``order`` come in any order.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    cut = written(
        rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in group], *keys).withColumn("_part", F.spark_partition_id()),
        "ranges",
    )
    zero = F.lit(0)
    grouped = [F.col(c) for c in group] or [F.lit(1)]
    earlier = Window.partitionBy(*grouped).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*grouped)
    counts = cut.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"_s_{v}") for v in values])
    carried = counts.select(
        *[F.col(c).alias(f"_k_{c}") for c in (*group, "_part")],
        F.coalesce(F.sum("_n").over(earlier), zero).alias("_rows"),
        F.sum("_n").over(whole).alias("group_rows"),
        *[F.coalesce(F.sum(f"_s_{v}").over(earlier), zero).alias(f"_c_{v}") for v in values],
        *[F.sum(f"_s_{v}").over(whole).alias(f"total_{v}") for v in values],
    )
    inside = Window.partitionBy(*group, "_part").orderBy(*keys)
    above = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumns(
        {"_r": F.row_number().over(inside) - 1} | {f"_l_{v}": F.coalesce(F.sum(v).over(above), zero) for v in values}
    )
    same = reduce(lambda a, b: a & b, [local[c].eqNullSafe(carried[f"_k_{c}"]) for c in (*group, "_part")])
    return local.join(carried, same).select(
        *rows.columns,
        (F.col("_rows") + F.col("_r")).cast("long").alias("rank"),
        "group_rows",
        *[(F.col(f"_c_{v}") + F.col(f"_l_{v}")).alias(f"before_{v}") for v in values],
        *[f"total_{v}" for v in values],
    )
