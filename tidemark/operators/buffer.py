"""The adaptive "most recent rows" buffer as a table.

Input is ``arrivals``: ``shard``, ``id``, ``t_ms`` and any other columns; the
order inside a shard is ``(t_ms, id)``.  The buffer a shard would hold after
each arrival follows from window functions alone.  With ``n`` the arrival
number and ``target`` the wanted size, the buffer grows by at most one row per
arrival and is cut to ``target`` when that is smaller, so

    occupancy = n + min(0, min over j <= n of (target_j - j))

and it always holds the newest ``occupancy`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidemark.functions.columns import (
    BUFFER_COEFFICIENT,
    DEFAULT_GAP_MS,
    GAP_HISTORY,
    MAX_BUFFER,
    MIN_BUFFER,
    target_size,
)
from tidemark.operators.lookups import asof
from tidemark.operators.ordered import Running, blocks, carry_over, largest_group, number_rows, running, task_rows
from tidemark.storage import cut_lineage, small_side, written

BY = ["shard"]
ARRIVAL = ["t_ms", "id"]  # ``id`` is unique
NARROW = [*BY, *ARRIVAL]  # all that the rules need; other columns are joined at the end


def timeline(
    arrivals: DataFrame,
    low: int = MIN_BUFFER,
    high: int = MAX_BUFFER,
    coefficient: float = BUFFER_COEFFICIENT,
    *,
    policy: Column | None = None,
    history: int = GAP_HISTORY,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Arrivals with everything the buffer did at each of them.

    Adds ``n`` (insertion id), ``gap``, ``mean_gap``, ``target``,
    ``occupancy``, ``released`` (ids up to here have left the buffer) and
    ``released_before``.  Columns nobody selects are pruned with their window.

    ``policy`` replaces the target rule by an expression over ``mean_gap``.

    A shard larger than ``rows_per_task`` is numbered in ranges, then cut into
    equal blocks that repeat the ``history`` rows ahead of them.
    """
    target = (policy if policy is not None else target_size("mean_gap", low, high, coefficient)).cast("long")
    if largest_group(arrivals, BY)[0] <= task_rows(arrivals, rows_per_task):
        window = Window.partitionBy(*BY).orderBy(*ARRIVAL)
        numbered = arrivals.withColumn("n", F.row_number().over(window).cast("long"))
        sized = _targets(numbered, window, target, history)
        room = F.col("target") - F.col("n")
        floors = sized.withColumns(
            {
                "_floor": F.min(room).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
                "_floor_before": F.min(room).over(window.rowsBetween(Window.unboundedPreceding, -1)),
            }
        )
    else:
        numbered = cut_lineage(number_rows(arrivals, BY, ARRIVAL, "n", rows_per_task=rows_per_task))
        cut = blocks(numbered, BY, "n", history + 1, rows_per_task)
        window = Window.partitionBy(*BY, "_block").orderBy("n")
        sized = _targets(cut, window, target, history).filter("_own").drop("_own")
        room = F.col("target") - F.col("n")
        values = {"_floor": Running("min", room), "_floor_before": Running("min", room, current=False)}
        floors = carry_over(sized, BY, "_block", ["n"], values).drop("_block")
    return floors.withColumns(
        {
            "occupancy": F.col("n") + F.least(F.lit(0), F.col("_floor")),
            "released": F.greatest(F.lit(0), -F.col("_floor")).cast("long"),
            "released_before": F.greatest(F.lit(0), F.coalesce(-F.col("_floor_before"), F.lit(0))).cast("long"),
        }
    ).drop("_floor", "_floor_before")


def recent_mean_gap(window, history: int) -> Column:
    """Mean of the last ``history`` gaps, from two times and a count.

    The gaps between two arrivals add up to the time between them, so no frame
    of ``history`` rows has to be summed for every row.  Needs ``n``.
    """
    ahead = F.lag("t_ms", history).over(window)
    start = F.first("t_ms").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    count = F.least(F.col("n") - 1, F.lit(history))
    return F.coalesce((F.col("t_ms") - F.coalesce(ahead, start)) / F.when(count > 0, count), F.lit(DEFAULT_GAP_MS))


def _targets(numbered: DataFrame, window, target: Column, history: int) -> DataFrame:
    gap = F.col("t_ms") - F.lag("t_ms").over(window)
    return numbered.withColumns({"gap": gap, "mean_gap": recent_mean_gap(window, history)}).withColumn("target", target)


def insertion_id(arrivals: DataFrame, **options) -> DataFrame:
    """Arrival number per shard, from 1."""
    return number_rows(arrivals, BY, ARRIVAL, "n", **options)


def _with_line(arrivals: DataFrame, *found: str, **options) -> DataFrame:
    """``arrivals`` with columns of its timeline; only shard, id and time take part in the windows."""
    line = timeline(arrivals.select(NARROW), **options)
    if set(arrivals.columns) == set(NARROW):
        return line.select(*arrivals.columns, *found)
    line = line.select(F.col("shard").alias("_shard"), F.col("id").alias("_id"), *found)
    same = arrivals["shard"].eqNullSafe(line["_shard"]) & (arrivals["id"] == line["_id"])
    return arrivals.join(line, same).select(*arrivals.columns, *found)


def gaps(arrivals: DataFrame, **options) -> DataFrame:
    """Milliseconds since the shard's previous arrival; NULL at the first."""
    return _with_line(arrivals, "gap", **options)


def mean_gap(arrivals: DataFrame, history: int = GAP_HISTORY, **options) -> DataFrame:
    """Mean of the last ``history`` gaps, 1000 ms before the first gap."""
    return _with_line(arrivals, "mean_gap", history=history, **options)


def target_sizes(arrivals: DataFrame, low=MIN_BUFFER, high=MAX_BUFFER, coefficient=BUFFER_COEFFICIENT, **options) -> DataFrame:
    """Wanted buffer size at each arrival."""
    return _with_line(arrivals, "n", "mean_gap", "target", low=low, high=high, coefficient=coefficient, **options)


def occupancy(arrivals: DataFrame, low=MIN_BUFFER, high=MAX_BUFFER, coefficient=BUFFER_COEFFICIENT, **options) -> DataFrame:
    """Rows in the buffer after each arrival."""
    return _with_line(arrivals, "n", "target", "occupancy", low=low, high=high, coefficient=coefficient, **options)


def evictions(arrivals: DataFrame, low=MIN_BUFFER, high=MAX_BUFFER, coefficient=BUFFER_COEFFICIENT, **options) -> DataFrame:
    """Which insertion id left the buffer at which arrival.

    The ids that have left never shrink, so one arrival evicts a run of ids
    and no join is needed.
    """
    line = timeline(arrivals.select(NARROW), low, high, coefficient, **options).filter("released > released_before")
    gone = F.explode(F.sequence(F.col("released_before") + 1, F.col("released")))
    return line.select("shard", gone.alias("insertion_id"), F.col("n").alias("evicted_by"), F.col("t_ms").alias("evicted_ms"))


def snapshot(
    arrivals: DataFrame, low=MIN_BUFFER, high=MAX_BUFFER, coefficient=BUFFER_COEFFICIENT, *, at_ms: int | None = None, **options
) -> DataFrame:
    """Rows in the buffer now, or as it was at ``at_ms``."""
    seen = arrivals if at_ms is None else arrivals.filter(F.col("t_ms") <= at_ms)
    line = timeline(seen.select(NARROW), low, high, coefficient, **options)
    last = line.groupBy(F.col("shard").alias("_shard")).agg(F.max_by("released", "n").alias("_released"))
    held = line.join(small_side(last), (F.col("shard") == F.col("_shard")) & (F.col("n") > F.col("_released")))
    keys = held.select("shard", "id", F.col("n").alias("insertion_id"))
    if set(arrivals.columns) == set(NARROW):
        return held.select(*arrivals.columns, F.col("n").alias("insertion_id"))
    # At most ``high`` rows per shard are left, so the other columns are
    # fetched by a broadcast of the keys and never shuffled.
    return seen.join(small_side(keys), ["shard", "id"]).select(*arrivals.columns, "insertion_id")


def shard_stats(arrivals: DataFrame, low=MIN_BUFFER, high=MAX_BUFFER, coefficient=BUFFER_COEFFICIENT, **options) -> DataFrame:
    """Rows in the buffer, smallest and largest insertion id in it, and rows seen, per shard."""
    line = timeline(arrivals.select(NARROW), low, high, coefficient, **options)
    last = line.groupBy("shard").agg(F.max("n").alias("rows_seen"), F.max_by("occupancy", "n").alias("rows_in_buffer"))
    return last.withColumns({"min_id": F.col("rows_seen") - F.col("rows_in_buffer") + 1, "max_id": F.col("rows_seen")})


def buffer_at(
    times: DataFrame,
    arrivals: DataFrame,
    low=MIN_BUFFER,
    high=MAX_BUFFER,
    coefficient=BUFFER_COEFFICIENT,
    *,
    time_id: str = "time_id",
    payload: tuple[str, ...] = ("id",),
    rows_per_task: int | None = None,
    **options,
) -> DataFrame:
    """The rows each training run sees: the shard's buffer as of the run's ``t_ms``.

    ``times`` has ``shard``, ``t_ms`` and a unique ``time_id``.  The buffer is
    the id range ``(released, n]`` of the last arrival at or before the run.
    Ranges are at most ``high`` long, so each touches at most two of the
    buckets ``insertion_id div high``, and the join is an equi-join on
    (shard, bucket) with at most ``high`` rows per bucket on the arrivals side.
    """
    line = timeline(arrivals.select(NARROW), low, high, coefficient, rows_per_task=rows_per_task, **options)
    state = line.select("shard", "t_ms", F.col("n").alias("_n"), "released")
    runs = asof(times, state, "t_ms", ["shard"], ["_n", "released"], left_tie=time_id, right_tie="_n", rows_per_task=rows_per_task)
    runs = runs.filter(F.col("_n").isNotNull())
    first, last = F.floor((F.col("released") + 1) / high), F.floor(F.col("_n") / high)
    spread = runs.select(
        "shard", time_id, F.col("t_ms").alias("trained_ms"), "_n", "released", F.explode(F.sequence(first, last)).alias("_bucket")
    )
    extra = [c for c in payload if c not in NARROW]
    numbered = line.select(*NARROW, "n")
    if extra:
        numbered = numbered.join(arrivals.select("shard", "id", *extra), ["shard", "id"])
    rows = numbered.select(
        F.col("shard").alias("_shard"), F.col("n").alias("insertion_id"), F.floor(F.col("n") / high).alias("_bucket2"), *payload
    )
    hit = (
        (F.col("shard") == F.col("_shard"))
        & (F.col("_bucket") == F.col("_bucket2"))
        & (F.col("insertion_id") > F.col("released"))
        & (F.col("insertion_id") <= F.col("_n"))
    )
    return spread.join(rows, hit).select("shard", time_id, "trained_ms", "insertion_id", *payload)


def buffer_summary_at(
    times: DataFrame,
    arrivals: DataFrame,
    low=MIN_BUFFER,
    high=MAX_BUFFER,
    coefficient=BUFFER_COEFFICIENT,
    *,
    value: str,
    time_id: str = "time_id",
    rows_per_task: int | None = None,
    **options,
) -> DataFrame:
    """What :func:`buffer_at` would give, summed up: ``rows, first_id, last_id, total, least, greatest`` of ``value`` per run.

    A run sees the insertion ids ``(released, n]``, so their number and ends are
    known, and no row is spread over the runs that see it.  The total comes
    from running sums.  Least and greatest come from two stretches of the
    largest power of two that fits: one ends at ``n``, one begins behind
    ``released``.  Every arrival knows those values for the stretches that end
    at it, so a run looks up two arrivals, whatever the size of the buffer.
    """
    line = written(timeline(arrivals.select(*NARROW, value), low, high, coefficient, rows_per_task=rows_per_task, **options).select(*BY, "t_ms", "n", "released", value), "line")
    x = F.col(value).cast("double")
    summed = running(line, BY, ["n"], {"_sum": Running("sum", F.coalesce(x, F.lit(0.0)))}, rows_per_task=rows_per_task)
    levels = int(high).bit_length()
    if largest_group(line, BY)[0] <= task_rows(line, rows_per_task):
        cut, window, own = summed, Window.partitionBy(*BY).orderBy("n"), F.lit(True)
    else:
        cut = blocks(summed, BY, "n", high, rows_per_task)
        window, own = Window.partitionBy(*BY, "_block").orderBy("n"), F.col("_own")
    # A stretch of twice the length is the one that ends here and the one that ends where it begins.
    cut = cut.withColumns({"_t0": F.coalesce(x, F.lit(0.0)), "_l0": x, "_g0": x})
    for k in range(1, levels):
        back = lambda c: F.lag(f"{c}{k - 1}", 1 << (k - 1)).over(window)  # noqa: B023, E731
        cut = cut.withColumns(
            {
                f"_t{k}": F.col(f"_t{k - 1}") + F.coalesce(back("_t"), F.lit(0.0)),
                f"_l{k}": F.least(f"_l{k - 1}", back("_l")),
                f"_g{k}": F.greatest(f"_g{k - 1}", back("_g")),
            }
        )
    each = lambda c: F.array(*[f"{c}{k}" for k in range(levels)])
    known = written(cut.filter(own).select(*BY, "t_ms", "n", "released", "_sum", each("_t").alias("_t"), each("_l").alias("_l"), each("_g").alias("_g")), "known")
    take = ["n", "released", "_sum", "_l", "_g"]
    runs = asof(times.select(*BY, "t_ms", time_id), known, "t_ms", BY, take, left_tie=time_id, right_tie="n", rows_per_task=rows_per_task)
    runs = runs.filter(F.col("n").isNotNull()).withColumn("_k", F.floor(F.log2((F.col("n") - F.col("released")).cast("double"))).cast("int"))
    runs = runs.withColumn("_at", F.expr("released + shiftleft(1L, _k)"))
    first = known.select(F.col("shard").alias("_shard"), F.col("n").alias("_n"), F.col("_sum").alias("_sum1"), "_t", F.col("_l").alias("_l1"), F.col("_g").alias("_g1"))
    both = runs.join(first, F.col("shard").eqNullSafe(F.col("_shard")) & (F.col("_at") == F.col("_n")))
    at = lambda c: F.get(c, F.col("_k"))
    return both.select(
        *BY,
        time_id,
        F.col("t_ms").alias("trained_ms"),
        (F.col("n") - F.col("released")).alias("rows"),
        (F.col("released") + 1).alias("first_id"),
        F.col("n").alias("last_id"),
        (F.col("_sum") - F.col("_sum1") + at("_t")).alias("total"),
        F.least(at("_l"), at("_l1")).alias("least"),
        F.greatest(at("_g"), at("_g1")).alias("greatest"),
    )


def arrival_rate(arrivals: DataFrame, minutes: int = 1) -> DataFrame:
    """Rows per shard and tumbling window of ``minutes``."""
    width = minutes * 60_000
    start = (F.floor(F.col("t_ms") / width) * width).cast("long")
    return arrivals.groupBy("shard", start.alias("window_ms")).agg(F.count(F.lit(1)).alias("rows"))
