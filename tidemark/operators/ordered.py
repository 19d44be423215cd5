"""Running values over an ordered group, however large one group is.

A window partitioned by a worker or shard puts the whole group in one task.
With four workers that is four tasks for the whole table, and one hot worker
is one task for a third of it.  Where a group is larger than
``rows_per_task`` the functions here cut the ordered rows into ranges, run the
window inside each range, reduce every range to one row, and add what the
earlier ranges carry over:

    running value = carry from earlier ranges (+) running value inside the range

Spark's own range partitioning decides where the cuts are, and the dealt rows
are written once, so a retried task sees the same ranges.  A NULL group is a
group like any other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from tidemark.storage import written

ROWS_PER_TASK = 4_000_000
WIDE_ROWS_PER_TASK = 250_000  # where rows hold texts, arrays or maps


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is count, sum, min, max or last (non-null).

    With ``current=False`` the current row is left out.
    """

    kind: str
    value: Column | None = None
    current: bool = True

    def frame(self, window):
        return window.rowsBetween(Window.unboundedPreceding, Window.currentRow if self.current else -1)

    def over(self, window) -> Column:
        if self.kind == "count":
            return F.count(F.lit(1)).over(window)
        if self.kind == "last":
            return F.last(self.value, ignorenulls=True).over(window)
        return getattr(F, self.kind)(self.value).over(window)

    def total(self, position: Column) -> Column:
        if self.kind == "count":
            return F.count(F.lit(1))
        if self.kind == "last":
            return F.max_by(self.value, F.when(self.value.isNotNull(), position))
        return getattr(F, self.kind)(self.value)

    def carry(self, total: str, window) -> Column:
        if self.kind in ("count", "sum"):
            return F.sum(total).over(window)
        if self.kind == "last":
            return F.last(total, ignorenulls=True).over(window)
        return getattr(F, self.kind)(total).over(window)

    def join(self, carried: Column, local: Column) -> Column:
        if self.kind == "count":
            return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
        if self.kind == "sum":
            return F.when(carried.isNull(), local).when(local.isNull(), carried).otherwise(carried + local)
        if self.kind == "min":
            return F.least(carried, local)
        if self.kind == "max":
            return F.greatest(carried, local)
        return F.coalesce(local, carried)


def task_rows(df: DataFrame, rows_per_task: int | None = None) -> int:
    """Rows one window task takes: as told, else by whether the rows are narrow."""
    return rows_per_task or (WIDE_ROWS_PER_TASK if _is_wide(df.schema) else ROWS_PER_TASK)


def _is_wide(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_is_wide(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.ArrayType, T.MapType, T.BinaryType, T.StringType, T.UserDefinedType))


def largest_group(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group (a NULL group is one) and of the table."""
    sizes = df.groupBy(*by).count() if by else df.select(F.count(F.lit(1)).alias("count"))
    largest, total = sizes.agg(F.max("count"), F.sum("count")).first()
    return largest or 0, total or 0


def in_ranges(df: DataFrame, by: Sequence[str], order: Sequence[str], ranges: int) -> DataFrame:
    """``df`` dealt out to about ``ranges`` ordered ranges numbered by ``_range``.

    The dealt rows are written to the shared folder, so that every later use
    and every retried task sees the same ranges, however many there are.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    return written(df.repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id()), "ranges")


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    values: dict[str, Running],
    *,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Add running values of ``df`` per ``by`` in ``order``.

    ``order`` must be a total order inside a group (end it with a unique id).
    """
    limit = task_rows(df, rows_per_task)
    largest, total = largest_group(df, by)
    if largest <= limit:
        window = Window.partitionBy(*by).orderBy(*order)
        return df.withColumns({name: r.over(r.frame(window)) for name, r in values.items()})

    cut = in_ranges(df, by, order, math.ceil(total / limit))
    return carry_over(cut, by, "_range", order, values).drop("_range")


def carry_over(cut: DataFrame, by, part: str, order, values: dict[str, Running]) -> DataFrame:
    """Running values of rows already cut into ordered parts numbered by ``part``."""
    inside = Window.partitionBy(*by, part).orderBy(*order)
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*by, part).agg(*[r.total(F.struct(*order)).alias(f"_t_{n}") for n, r in values.items()])
    carried = totals.select(
        *[F.col(c).alias(f"_k_{c}") for c in (*by, part)],
        *[r.carry(f"_t_{n}", earlier).alias(f"_c_{n}") for n, r in values.items()],
    )
    local = cut.withColumns({f"_l_{n}": r.over(r.frame(inside)) for n, r in values.items()})
    match = [local[c].eqNullSafe(carried[f"_k_{c}"]) for c in by] + [local[part] == carried[f"_k_{part}"]]
    joined = local.join(carried, match, "left")
    return joined.select(
        *cut.columns,
        *[r.join(F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, r in values.items()],
    )


def number_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str, *, start: int = 1, rows_per_task: int | None = None) -> DataFrame:
    """``row_number`` per group as LONG, counted from ``start``."""
    out = running(df, by, order, {name: Running("count")}, rows_per_task=rows_per_task)
    return out.withColumn(name, (F.col(name) + (start - 1)).cast("long")) if start != 1 else out


def blocks(df: DataFrame, by: Sequence[str], number: str, before: int, rows_per_task: int | None = None) -> DataFrame:
    """Cut numbered rows into equal blocks that also hold the ``before`` rows ahead of them.

    Adds ``_block`` and ``_own``; rows with ``_own`` false are the copies taken
    from the previous block and must be dropped after the window is done.
    """
    size = max(task_rows(df, rows_per_task), before)
    place = F.col(number) - 1
    own = F.floor(place / size).cast("long")
    targets = F.when(place % size >= size - before, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_block", F.explode(targets)).withColumn("_own", own == F.col("_block"))


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int, rows_per_task: int | None = None) -> DataFrame:
    """The first ``n`` rows of every group.

    Spark limits each group before the shuffle by itself where ``n`` is small;
    for more, rows are numbered in ranges.
    """
    if n < 1000:
        window = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n).drop("_rn")
    numbered = number_rows(df, by, order, "_rn", rows_per_task=rows_per_task)
    return numbered.filter(F.col("_rn") <= n).drop("_rn")
