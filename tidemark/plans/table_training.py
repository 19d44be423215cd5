"""Local fits of a model that no process has to hold.

L-BFGS needs its vectors (point, gradient, the last steps and turns) only in
sums and in inner products.  Here every vector is a column of one table with a
row per group, class and feature.  The driver sees the inner products, a small
matrix per group, and finds in them the direction as weights of those columns.

A margin is linear in the weights, so one pass over the examples gives the
margins of the direction, and every length along it is tried on the margins
alone.  A step is two passes: one for these margins, one for the gradient.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.columns import BIAS, LOCAL_ITERATIONS
from tidemark.functions.softmax import MEMORY, TOLERANCE, TRIES, StepLength
from tidemark.operators.prep import long_vectors
from tidemark.operators.scoring import cross_entropy, softmax_of
from tidemark.operators.weights import KEY, combine
from tidemark.storage import written


def row_vectors(examples: DataFrame, by: str) -> DataFrame:
    """``by, row_id, label, feature, x`` with the intercept; each example is numbered once."""
    rows = examples.select(F.col(by).cast("long").alias(by), F.col("label").cast("int").alias("label"), "features", F.monotonically_increasing_id().alias("row_id"))
    return long_vectors(written(rows, "rows"), by, "row_id", "label", bias=True)


def fit_tables(vectors: DataFrame, weights: DataFrame, iterations: int = LOCAL_ITERATIONS, by: str = "shard") -> DataFrame:
    """``by, class, feature, delta, loss, rows``, as :func:`tidemark.plans.training.local_fit` gives them.

    ``vectors`` has ``by, row_id, label, feature, x`` and feature -1 for the
    intercept; ``weights`` has ``class, feature, value`` for all groups, or
    ``by`` as well.  Labels lie in the classes of ``weights``.  The driver holds
    a few hundred numbers per group, executors hold ranges of tables.
    """
    spark = vectors.sparkSession
    sizes = {r[0]: r[1] for r in vectors.filter(F.col("feature") == BIAS).groupBy(by).count().collect()}
    classes = (weights.agg(F.max("class")).first()[0] or 0) + 1
    state = written(_start(vectors, weights, sizes, by), "state")
    rows = written(_margins(vectors, state, F.col("point"), classes, by), "margins")
    losses = {r[by]: r["loss"] / sizes[r[by]] for r in rows.groupBy(by).agg(F.sum(cross_entropy("z", "label")).alias("loss")).collect()}
    if not losses:
        return _result(state, {}, sizes, by)
    state = written(_with_gradient(state, vectors, rows, classes, sizes, by), "state")
    pairs: dict[int, list[bool]] = {g: [] for g in losses}  # which remembered steps count
    going = set(losses)
    for iteration in range(iterations):
        products = _inner_products(state, min(iteration, MEMORY), by)
        plans = {}
        for group in sorted(going):
            matrix = products[group]
            if math.sqrt(matrix[-1, -1]) <= TOLERANCE * max(1.0, abs(losses[group])):
                continue
            m = len(matrix) // 2
            pairs[group] = [p and matrix[i, m + i] > 1e-12 for i, p in enumerate(pairs[group])]
            mix = -inverse_hessian_mix(matrix, pairs[group])
            slope = float(mix @ matrix[:, -1])
            if slope >= 0:
                pairs[group] = [False] * m
                mix, slope = -np.eye(len(matrix))[-1], -float(matrix[-1, -1])
            first = 1.0 / math.sqrt(mix @ matrix @ mix) if iteration == 0 else 1.0
            plans[group] = (mix, StepLength(losses[group], slope, first))
        if not plans:
            break
        mixes = _per_group(spark, by, {g: mix.tolist() for g, (mix, _) in plans.items()}, "array<double>")
        basis = F.concat("steps", "turns", F.array("gradient"))
        along = F.coalesce(F.aggregate(F.zip_with("_value", basis, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b), F.lit(0.0))
        state = written(state.join(mixes, by, "left").withColumn("direction", along).drop("_value"), "state")
        moves = _margins(vectors, state, F.col("direction"), classes, by).select(by, "row_id", F.col("z").alias("dz"))
        rows = written(rows.join(moves, [by, "row_id"]), "margins")
        lengths = _search(rows, {g: search for g, (_, search) in plans.items()}, sizes, by)
        losses |= {g: loss for g, (_, loss) in lengths.items()}
        going = set(lengths)
        step = _per_group(spark, by, {g: lengths[g][0] if g in lengths else 0.0 for g in sizes}, "double")
        moved = F.zip_with("z", "dz", lambda z, d: z + F.col("_value") * d)
        rows = written(rows.join(step, by).select(by, "row_id", "label", moved.alias("z")), "margins")
        state = state.join(step, by).withColumns({"point": F.col("point") + F.col("_value") * F.col("direction"), "step": F.col("_value") * F.col("direction")})
        state = _with_gradient(state.withColumnRenamed("gradient", "before").drop("_value", "direction"), vectors, rows, classes, sizes, by)
        recent = {"steps": F.col("step"), "turns": F.col("gradient") - F.col("before")}
        kept = {name: F.slice(F.concat(F.array(new), F.reverse(name)), 1, MEMORY) for name, new in recent.items()}
        state = written(state.withColumns({name: F.reverse(column) for name, column in kept.items()}).drop("step", "before"), "state")
        pairs = {g: [*p, g in lengths][-MEMORY:] for g, p in pairs.items()}
    return _result(state, losses, sizes, by)


def _start(vectors, weights, sizes, by) -> DataFrame:
    """Weights of every group, scaled by the feature's deviation in the group; constant features stay as they are."""
    n = F.col("_value")
    moments = vectors.groupBy(by, "feature").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    moments = moments.join(_per_group(vectors.sparkSession, by, sizes, "long"), by)
    variance = (F.col("q") - F.col("s") * F.col("s") / n) / (n - 1)
    varies = variance > 1e-12 * F.greatest(F.lit(1.0), F.col("q") / n)
    scale = F.when((F.col("feature") == BIAS) | (n < 2), 1.0).when(varies, F.sqrt(variance)).otherwise(0.0)
    scales = moments.select(by, "feature", scale.alias("scale"))
    if by not in weights.columns:
        groups = F.array(*[F.lit(g).cast("long") for g in sorted(sizes)])
        weights = weights.withColumn(by, F.explode(groups if sizes else F.array().cast("array<long>")))
    # A feature that no row of the group has is 0 throughout, which is no deviation; a lone row scales nothing.
    lone = F.array(*[F.lit(g).cast("long") for g, size in sorted(sizes.items()) if size < 2]).cast("array<long>")
    missing = F.when(F.array_contains(lone, F.col(by)), 1.0).otherwise(0.0)
    scaled = weights.select(F.col(by).cast("long").alias(by), *KEY, "value").join(scales, [by, "feature"], "left").withColumn("scale", F.coalesce("scale", missing))
    none = F.array().cast("array<double>")
    return scaled.select(by, *KEY, "value", "scale", (F.col("value") * F.col("scale")).alias("point"), none.alias("steps"), none.alias("turns"))


def _unscaled(column: Column) -> Column:
    return F.when(F.col("scale") > 0, column / F.col("scale")).otherwise(0.0)


def _margins(vectors, state, column, classes, by) -> DataFrame:
    """``by, row_id, label, z``: per row, the margins under one column of the state."""
    own = state.select(by, *KEY, _unscaled(column).alias("_v"))
    wide = own.groupBy(by, "feature").agg(*[F.coalesce(F.max(F.when(F.col("class") == c, F.col("_v"))), F.lit(0.0)).alias(f"_w{c}") for c in range(classes)])
    sums = [F.sum(F.col("x") * F.col(f"_w{c}")).alias(f"_z{c}") for c in range(classes)]
    rows = vectors.join(wide, [by, "feature"]).groupBy(by, "row_id").agg(F.max("label").alias("label"), *sums)
    return rows.select(by, "row_id", "label", F.array(*[f"_z{c}" for c in range(classes)]).alias("z"))


def _with_gradient(state, vectors, rows, classes, sizes, by) -> DataFrame:
    """Add ``gradient``, the scaled slope of the mean loss at the margins in ``rows``."""
    labels = F.array(*[F.lit(c) for c in range(classes)])
    residual = F.zip_with(softmax_of("z"), labels, lambda p, c: p - F.when(c == F.col("label"), 1.0).otherwise(0.0))
    # Exploded vectors are far larger than Spark takes them for; they must not be broadcast.
    hit = vectors.select(by, "row_id", "feature", "x").join(rows.select(by, "row_id", residual.alias("_r")).hint("merge"), [by, "row_id"])
    parts = [F.sum(F.get("_r", F.lit(c)) * F.col("x")).alias(f"_g{c}") for c in range(classes)]
    cells = F.array(*[F.struct(F.lit(c).cast("int").alias("class"), F.col(f"_g{c}").alias("_sum")) for c in range(classes)])
    sums = hit.groupBy(by, "feature").agg(*parts).select(by, "feature", F.inline(cells))
    n = _per_group(state.sparkSession, by, sizes, "long")
    joined = state.join(sums, [by, *KEY], "left").join(n, by)
    return joined.withColumn("gradient", _unscaled(F.coalesce("_sum", F.lit(0.0))) / F.col("_value")).drop("_sum", "_value")


def _inner_products(state, remembered, by) -> dict[int, np.ndarray]:
    """Per group, all products of the remembered steps, turns and the gradient, in this order."""
    vectors = [F.get("steps", F.lit(i)) for i in range(remembered)] + [F.get("turns", F.lit(i)) for i in range(remembered)] + [F.col("gradient")]
    cells = [(i, j) for i in range(len(vectors)) for j in range(i, len(vectors))]
    found = state.groupBy(by).agg(*[F.sum(vectors[i] * vectors[j]).alias(f"_{i}_{j}") for i, j in cells]).collect()
    out = {}
    for r in found:
        matrix = np.zeros((len(vectors), len(vectors)))
        for i, j in cells:
            matrix[i, j] = matrix[j, i] = r[f"_{i}_{j}"]
        out[r[by]] = matrix
    return out


def inverse_hessian_mix(products: np.ndarray, counts: list[bool]) -> np.ndarray:
    """The inverse Hessian times the gradient, as weights of steps, turns and gradient.

    ``products`` are their inner products; pairs that do not count are left
    out.  The recursion never sees a vector: a product with a mix of vectors
    is the mix of their products.
    """
    m = len(products) // 2
    mix, used = np.eye(len(products))[-1], {}
    known = [i for i in range(m) if counts[i]]
    for i in reversed(known):
        used[i] = (products[i] @ mix) / products[i, m + i]
        mix[m + i] -= used[i]
    if known:
        i = known[-1]
        mix *= products[i, m + i] / products[m + i, m + i]
    for i in known:
        mix[i] += used[i] - (products[m + i] @ mix) / products[i, m + i]
    return mix


def _search(rows, searches: dict[int, StepLength], sizes, by) -> dict[int, tuple[float, float]]:
    """Per group, the length along its direction and the loss there; groups without any gain are left out."""
    spark, found, best, asking = rows.sparkSession, {}, {}, dict(searches)
    for _ in range(TRIES):
        lengths = _per_group(spark, by, {g: s.length for g, s in asking.items()}, "double")
        tried = rows.join(lengths, by).withColumn("_u", F.zip_with("z", "dz", lambda z, d: z + F.col("_value") * d))
        expected = F.aggregate(F.zip_with(softmax_of("_u"), "dz", lambda p, d: p * d), F.lit(0.0), lambda a, v: a + v)
        slope = expected - F.element_at("dz", F.col("label") + 1)
        for r in tried.groupBy(by).agg(F.sum(cross_entropy("_u", "label")).alias("loss"), F.sum(slope).alias("slope")).collect():
            group, length = r[by], asking[r[by]].length
            loss = r["loss"] / sizes[group]
            better, done = asking[group].tell(loss, r["slope"] / sizes[group])
            if better or done:
                best[group] = (length, loss)
            if done:
                found[group] = best[group]
                del asking[group]
        if not asking:
            break
    return best | found


def _per_group(spark: SparkSession, by: str, values: dict[int, object], kind: str) -> DataFrame:
    """``by, _value``: one small row per group, to be joined to tables."""
    table = pa.table({by: pa.array(list(values), pa.int64()), "_value": pa.array(list(values.values()), _ARROW[kind])})
    return F.broadcast(spark.createDataFrame(table, f"`{by}` long, _value {kind}"))


_ARROW = {"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def _result(state, losses, sizes, by) -> DataFrame:
    ends = {g: [losses[g], float(sizes[g])] for g in losses}
    delta = F.when(F.col("scale") > 0, F.col("point") / F.col("scale") - F.col("value")).otherwise(0.0)
    done = state.join(_per_group(state.sparkSession, by, ends, "array<double>"), by)
    return done.select(by, *KEY, delta.alias("delta"), F.get("_value", F.lit(0)).alias("loss"), F.get("_value", F.lit(1)).cast("long").alias("rows"))


def step_tables(vectors: DataFrame, weights: DataFrame, rate: float, by: str = "shard") -> DataFrame:
    """One full-batch gradient step per group, in the columns of :func:`fit_tables`."""
    classes = (weights.agg(F.max("class")).first()[0] or 0) + 1
    sizes = {r[0]: r[1] for r in vectors.filter(F.col("feature") == BIAS).groupBy(by).count().collect()}
    groups = F.array(*[F.lit(g).cast("long") for g in sorted(sizes)]).cast("array<long>")
    own = weights if by in weights.columns else weights.withColumn(by, F.explode(groups))
    state = written(own.withColumn("scale", F.lit(1.0)), "state")
    rows = written(_margins(vectors, state, F.col("value"), classes, by), "margins")
    losses = rows.groupBy(by).agg(F.avg(cross_entropy("z", "label")).alias("loss"), F.count(F.lit(1)).alias("rows"))
    steps = _with_gradient(state, vectors, rows, classes, sizes, by)
    return steps.join(losses, by).select(by, *KEY, (-rate * F.col("gradient")).alias("delta"), "loss", "rows")


def train_tables(examples: DataFrame, weights: DataFrame, rounds: int, num_workers: int, *, rate: float | None = None, iterations: int = LOCAL_ITERATIONS, by: str = "shard") -> list[DataFrame]:
    """Weights tables after 0, 1 ... ``rounds`` rounds in which all workers step together."""
    vectors = row_vectors(examples, by)
    history = [written(weights, "weights")]
    for _ in range(rounds):
        now = history[-1]
        deltas = fit_tables(vectors, now, iterations, by) if rate is None else step_tables(vectors, now, rate, by)
        history.append(written(combine(now, deltas, num_workers), "weights"))
    return history
