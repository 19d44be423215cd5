import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import buffer, clocks, lookups, ordered
from tidemark.operators.ordered import Running
from tests.folds import buffer_fold, release_fold


def skewed(spark, n=600, seed=3):
    """A third of all rows share one group and one time."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        rows.append((0 if hot else rng.randrange(4), 500 if hot else rng.randrange(1000), i, rng.choice([None, *range(50)])))
    return spark.createDataFrame(rows, "g long, t long, id long, v long")


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.mark.parametrize("kind", ["count", "sum", "min", "max", "last"])
@pytest.mark.parametrize("current", [True, False])
@pytest.mark.parametrize("by", [["g"], []])
def test_ranges_give_what_one_window_gives(spark, kind, current, by):
    df = skewed(spark)
    value = {"r": Running(kind, None if kind == "count" else F.col("v"), current)}
    plain = ordered.running(df, by, ["t", "id"], value)
    cut = ordered.running(df, by, ["t", "id"], value, rows_per_task=40)
    assert rows_of(plain, "g", "t", "id", "r") == rows_of(cut, "g", "t", "id", "r")


def test_ranges_are_even_although_one_group_and_time_is_hot(spark):
    cut = ordered.in_ranges(skewed(spark, 3000), ["g"], ["t", "id"], 30)
    sizes = [r["count"] for r in cut.groupBy("_range").count().collect()]
    assert len(sizes) >= 20 and max(sizes) < 400
    in_order = [r["_range"] for r in cut.orderBy("g", "t", "id").collect()]
    assert in_order == sorted(in_order)


@pytest.mark.parametrize("kind", ["count", "sum", "min", "max", "last"])
def test_a_null_group_is_a_group_in_both_forms(spark, kind):
    df = spark.createDataFrame([(i % 3 or None, i * 7 % 50, i, i % 5 or None) for i in range(60)], "g long, t long, id long, v long")
    value = {"r": Running(kind, None if kind == "count" else F.col("v"))}
    forms = [rows_of(ordered.running(df, ["g"], ["t", "id"], value, rows_per_task=n), "g", "t", "id", "r") for n in (5, 10**6)]
    assert forms[0] == forms[1] and len(forms[0]) == 60


def test_every_user_of_running_keeps_null_groups(spark):
    arrivals = spark.createDataFrame([(i % 2 or None, i, i * 10) for i in range(60)], "shard long, id long, t_ms long")
    trace = arrivals.select(F.col("shard").alias("worker"), F.col("id").alias("clock"), "t_ms")
    for use in (
        lambda n: buffer.occupancy(arrivals, 2, 8, 1.0, rows_per_task=n),
        lambda n: buffer.gaps(arrivals, rows_per_task=n),
        lambda n: ordered.number_rows(arrivals, ["shard"], ["t_ms", "id"], "n", rows_per_task=n),
        lambda n: lookups.asof(trace, trace.withColumn("x", F.col("clock")), "t_ms", ["worker"], ["x"], left_tie="clock", right_tie="clock", rows_per_task=n),
        lambda n: clocks.worker_clock(arrivals.withColumnRenamed("shard", "worker"), ["t_ms", "id"], rows_per_task=n),
    ):
        small, large = (sorted(map(tuple, use(n).collect()), key=repr) for n in (5, 10**6))
        assert small == large and len(small) == 60


def test_first_rows_small_and_large(spark):
    df = skewed(spark, 5000)
    few = ordered.first_rows(df, ["g"], ["t", "id"], 5)
    assert few.count() == 20
    many = ordered.first_rows(df, ["g"], ["t", "id"], 1200, rows_per_task=300)
    window = Window.partitionBy("g").orderBy("t", "id")
    want = df.withColumn("rn", F.row_number().over(window)).filter("rn <= 1200")
    assert rows_of(many, "id") == rows_of(want, "id")


def arrivals_frame(spark, seed, shards=3, n=900):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([0, 0, 1, 5, 40, 300, 5000]) if rng.random() < 0.9 else rng.randrange(20000)
        shard = 0 if rng.random() < 0.6 else rng.randrange(shards)
        rows.append((shard, i, t, float(i)))
    return rows, spark.createDataFrame(rows, "shard long, id long, t_ms long, value double")


@pytest.mark.parametrize("rows_per_task", [None, 60])
@pytest.mark.parametrize("seed", [1, 2])
def test_buffer_equals_fold(spark, rows_per_task, seed):
    rows, df = arrivals_frame(spark, seed)
    options = dict(history=20, rows_per_task=rows_per_task)
    line = buffer.timeline(df, 4, 30, 0.2, **options).collect()
    gone = {(r["shard"], r["insertion_id"]): r["evicted_by"] for r in buffer.evictions(df, 4, 30, 0.2, **options).collect()}
    for shard in {r[0] for r in rows}:
        times = [r[2] for r in rows if r[0] == shard]
        want = buffer_fold(times, 4, 30, 0.2, 20)
        got = sorted((r["n"], r["target"], r["occupancy"]) for r in line if r["shard"] == shard)
        assert got == [w[:3] for w in want]
        evicted = {i: n for n, _, _, ids in want for i in ids}
        assert {i: n for (s, i), n in gone.items() if s == shard} == evicted


def test_buffer_bounds_and_newest_rows(spark):
    _, df = arrivals_frame(spark, 5)
    for r in buffer.timeline(df, 4, 30, 0.2).collect():
        assert 1 <= r["occupancy"] <= 30 and r["released"] == r["n"] - r["occupancy"]
    kept = buffer.snapshot(df, 4, 30, 0.2)
    ends = kept.groupBy("shard").agg(F.min("insertion_id").alias("a"), F.max("insertion_id").alias("b"), F.count("*").alias("c"))
    stats = {r["shard"]: r for r in buffer.shard_stats(df, 4, 30, 0.2).collect()}
    for r in ends.collect():
        assert r["b"] - r["a"] + 1 == r["c"] == stats[r["shard"]]["rows_in_buffer"]
        assert r["b"] == stats[r["shard"]]["rows_seen"]


def test_one_row_equal_times_and_zero_gaps(spark):
    one = spark.createDataFrame([(0, 1, 10)], "shard long, id long, t_ms long")
    row = buffer.timeline(one, 4, 30, 0.2).collect()[0]
    assert (row["n"], row["gap"], row["mean_gap"], row["target"], row["occupancy"]) == (1, None, 1000.0, 12, 1)
    same = spark.createDataFrame([(0, i, 10) for i in range(50)], "shard long, id long, t_ms long")
    assert {r["target"] for r in buffer.timeline(same, 4, 30, 0.2).filter("n > 1").collect()} == {30}
    assert buffer.snapshot(same, 4, 30, 0.2).count() == 30


def test_no_arrivals(spark):
    none = spark.createDataFrame([], "shard long, id long, t_ms long, value double")
    assert buffer.snapshot(none).count() == 0 and buffer.evictions(none).count() == 0


def test_snapshot_keeps_the_other_columns(spark):
    _, df = arrivals_frame(spark, 9)
    kept = buffer.snapshot(df, 4, 30, 0.2)
    assert kept.columns == [*df.columns, "insertion_id"]
    assert all(r["value"] == float(r["id"]) for r in kept.collect())


def test_target_policy_is_a_column(spark):
    _, df = arrivals_frame(spark, 7)
    flat = buffer.timeline(df, policy=F.lit(5)).filter("n >= 5")
    assert {r["occupancy"] for r in flat.collect()} == {5}


def test_buffer_needs_room_for_a_row(spark):
    _, df = arrivals_frame(spark, 7)
    with pytest.raises(ValueError):
        buffer.timeline(df, low=0)


@pytest.mark.parametrize("rows_per_task", [None, 70])
def test_buffer_at_equals_fold(spark, rows_per_task):
    rows, df = arrivals_frame(spark, 11, n=500)
    runs = [(s, t, k) for k, (s, t) in enumerate([(0, 100), (0, 3000), (1, 50_000), (2, 10**9), (0, 10**9)])]
    times = spark.createDataFrame(runs, "shard long, t_ms long, time_id long")
    seen = buffer.buffer_at(times, df, 4, 30, 0.2, history=20, rows_per_task=rows_per_task).collect()
    for shard, t, k in runs:
        mine = [r for r in rows if r[0] == shard]
        fold = buffer_fold([r[2] for r in mine], 4, 30, 0.2, 20)
        past = [f for r, f in zip(mine, fold) if r[2] <= t]
        want = [] if not past else list(range(past[-1][0] - past[-1][2] + 1, past[-1][0] + 1))
        assert sorted(r["insertion_id"] for r in seen if r["time_id"] == k) == want


@pytest.mark.parametrize("rows_per_task", [None, 30])
def test_asof_equals_scan(spark, rows_per_task):
    rng = random.Random(4)
    left = [(rng.randrange(3), rng.randrange(100), i) for i in range(120)]
    right = [(rng.randrange(3), rng.randrange(100), i, f"v{i}") for i in range(60)]
    got = lookups.asof(
        spark.createDataFrame(left, "k long, t long, id long"),
        spark.createDataFrame(right, "k long, t long, ver long, name string"),
        "t", ["k"], ["name"], left_tie="id", right_tie="ver", rows_per_task=rows_per_task,
    )
    want = []
    for k, t, i in left:
        past = [(u, v, n) for kk, u, v, n in right if kk == k and u <= t]
        want.append((i, max(past)[2] if past else None))
    assert rows_of(got, "id", "name") == sorted(want, key=repr)


@pytest.mark.parametrize("delay", [0, -1, 1, 3, 10])
def test_release_equals_fold(spark, delay):
    rng = random.Random(delay + 20)
    trace, t = [], 0
    clock = [0] * 4
    rows = []
    for _ in range(150):
        w = rng.choice([0, 1, 2, 3, 3, 3])
        t += rng.randrange(1, 9)
        rows.append((w, clock[w], t))
        clock[w] += 1
        trace.append((t, w))
    df = spark.createDataFrame(rows, "worker long, clock long, t_ms long")
    out = clocks.release_schedule(df, 4, delay).collect()
    got = {(r["worker"], r["clock"]): r["released_ms"] for r in out if r["released_ms"] is not None}
    want = release_fold(trace, 4, delay)
    # The fold only ever waits for a worker's latest clock; earlier ones were
    # overtaken on a trace that was not recorded under this delay.
    for key, when in want.items():
        assert got[key] == when
    assert clocks.violations(df, 4, delay).count() == sum(
        1 for r in clocks.clock_gap(df, 4).collect() if delay >= 0 and r["gap"] > delay + 1
    )


def test_clock_gap_cut_into_ranges(spark):
    rows = [(w, c, 10 * c + w * (c % 3)) for w in range(4) for c in range(60)]
    df = spark.createDataFrame(rows, "worker long, clock long, t_ms long")
    plain, cut = clocks.clock_gap(df, 4), clocks.clock_gap(df, 4, rows_per_task=25)
    assert rows_of(plain, *plain.columns) == rows_of(cut, *cut.columns)


def test_gate(spark):
    state = spark.createDataFrame([(0, 5), (1, 2), (2, 3), (3, 2)], "worker long, clock long")
    pending = spark.createDataFrame([(0,), (1,), (2,)], "worker long")
    free = lambda d: sorted(r["worker"] for r in clocks.gate(state, pending, d).collect())
    assert free(0) == [1] and free(1) == [1, 2] and free(3) == [0, 1, 2] and free(-1) == [0, 1, 2]
    assert clocks.gate(state, pending.limit(0), 0).count() == 0


@pytest.mark.parametrize("rows_per_task", [None, 40])
def test_summaries_of_buffers_equal_their_rows(spark, rows_per_task):
    """Two lookups a run against the rows themselves, in one task per shard and in blocks; with NULL values and early runs."""
    _, df = arrivals_frame(spark, 11, n=300)
    df = df.withColumn("value", F.when(F.col("id") % 13 != 0, F.col("value")))
    times = df.select("shard", (F.col("t_ms") + F.col("id") % 5 * 40 - 100).alias("t_ms"), (F.col("id") + 1000).alias("time_id"))
    rows = buffer.buffer_at(times, df, 4, 30, 0.2, history=20, payload=("value",)).groupBy("shard", "time_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("insertion_id").alias("first_id"),
        F.max("insertion_id").alias("last_id"),
        F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 6).alias("total"),
        F.min("value").alias("least"),
        F.max("value").alias("greatest"),
    )
    got = buffer.buffer_summary_at(times, df, 4, 30, 0.2, history=20, value="value", rows_per_task=rows_per_task).withColumn("total", F.round("total", 6))
    columns = ["shard", "time_id", "rows", "first_id", "last_id", "total", "least", "greatest"]
    assert rows_of(got, *columns) == rows_of(rows, *columns)
    assert got.count() > 200
