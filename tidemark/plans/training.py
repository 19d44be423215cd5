"""Local fits, synchronous rounds and evaluation of a shared model.

Rows never move between rounds: every round is one Spark job that sends the
weights to the rows and brings one partial sum per shard and key back.  The
driver holds the model up to a limit; beyond it weights are tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import softmax
from tidemark.functions.columns import LOCAL_ITERATIONS, NUM_WORKERS
from tidemark.operators.quality import f1_accuracy
from tidemark.operators.scoring import gradient_step, gradient_sums, moment_sums, predict, predict_versions
from tidemark.operators import weights as model
from tidemark.operators.weights import combine, weight_arrays, weights_frame
from tidemark.plans.table_training import fit_tables, row_vectors, train_tables

MAX_GROUP_ROWS = 16_384  # a buffer is far smaller; larger groups are fitted over all executors

FIT_SCHEMA = "class int, feature int, delta double, loss double, rows long"


def local_fit(
    examples: DataFrame,
    weights: np.ndarray | dict[int, np.ndarray] | DataFrame,
    iterations: int = LOCAL_ITERATIONS,
    by: str = "shard",
    *,
    bounded: bool | None = None,
) -> DataFrame:
    """New minus old weights per group after a few L-BFGS steps from the shared weights.

    No regularisation, features scaled by their deviation inside the group,
    the set of classes fixed by ``weights``.  Also gives the loss at the end
    and the rows of the group.

    Groups of at most ``MAX_GROUP_ROWS`` rows (buffers) are fitted in one task
    each.  Where a group is larger, every step of all groups is one pass over
    all rows and only gradients leave the tasks.  ``bounded=True`` skips the
    check for groups known to be buffers.

    Weights given as a table, arrays over the broadcast limit, and large groups
    whose sums together would be over it, stay tables throughout; see :mod:`tidemark.plans.table_training`.
    """
    if isinstance(weights, DataFrame) or not fits_a_process(weights):
        return fit_tables(row_vectors(examples, by), _as_table(examples.sparkSession, weights, by), iterations, by)
    if bounded is None:
        bounded = groups_are_bounded(examples, by)
    if bounded:
        return _fit_in_tasks(examples, weights, iterations, by)
    size = (next(iter(weights.values())) if isinstance(weights, dict) else weights).size
    if examples.agg(F.count_distinct(by)).first()[0] * size > model.MAX_BROADCAST_WEIGHTS:
        return fit_tables(row_vectors(examples, by), _as_table(examples.sparkSession, weights, by), iterations, by)
    return _fit_over_rows(examples, weights, iterations, by)


def fits_a_process(weights: np.ndarray | dict[int, np.ndarray]) -> bool:
    """All arrays together are within the broadcast limit."""
    arrays = weights.values() if isinstance(weights, dict) else [weights]
    return sum(a.size for a in arrays) <= model.MAX_BROADCAST_WEIGHTS


def _as_table(spark, weights, by: str) -> DataFrame:
    if isinstance(weights, DataFrame):
        return weights
    if not isinstance(weights, dict):
        return weights_frame(spark, weights)
    tables = [weights_frame(spark, w).withColumn(by, F.lit(g).cast("long")) for g, w in weights.items()]
    return reduce(DataFrame.unionByName, tables)


def groups_are_bounded(examples: DataFrame, by: str) -> bool:
    """No group is larger than one task should hold."""
    largest = examples.groupBy(by).count().agg(F.max("count")).first()[0] or 0
    return largest <= MAX_GROUP_ROWS


def _fit_in_tasks(examples, weights, iterations, by):
    shared = not isinstance(weights, dict)
    width = (weights if shared else next(iter(weights.values()))).shape[1] - 1
    sent = examples.sparkSession.sparkContext.broadcast(weights)
    narrow = examples.select(F.col(by).cast("long").alias(by), F.col("label").cast("int").alias("label"), "features")

    def fit(key, table):
        group = int(key[0].as_py())
        old = sent.value if shared else sent.value.get(group)
        names = [by, "class", "feature", "delta", "loss", "rows"]
        if old is None:
            types = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64()]
            return pa.table([pa.array([], t) for t in types], names=names)
        x = softmax.with_bias(softmax.dense_block(table.column("features"), width))
        y = table.column("label").to_numpy()
        delta, loss = softmax.fit_block(x, y, old, iterations)
        c, f = (a.ravel().astype(np.int32) for a in np.indices(delta.shape))
        size = delta.size
        return pa.table(
            [np.full(size, group, np.int64), c, f - 1, delta.ravel(), np.full(size, loss), np.full(size, len(y), np.int64)],
            names=names,
        )

    return narrow.groupBy(by).applyInArrow(fit, f"`{by}` long, {FIT_SCHEMA}")


def _fit_over_rows(examples, weights, iterations, by):
    spark = examples.sparkSession
    width = (next(iter(weights.values())) if isinstance(weights, dict) else weights).shape[1] - 1
    moments = _arrays(moment_sums(examples, width, by), by, (1, width + 1), ("total", "squares"))
    old = weights if isinstance(weights, dict) else {g: weights for g in moments}
    shape = next(iter(old.values())).shape
    scales, steps, points, done = {}, {}, {}, {}
    for group in old.keys() & moments.keys():
        (total, squares), _, n = moments[group]
        scales[group] = softmax.scale_of(total[0], squares[0], n)
        steps[group] = softmax.lbfgs(old[group] * scales[group], iterations)
        points[group] = next(steps[group])
    while points:
        asked = {g: softmax.unscale(p, scales[g]) for g, p in points.items()}
        answers = _arrays(gradient_sums(examples, asked, by), by, shape, ("gradient",))
        for group in list(points):
            (gradient,), loss, n = answers[group]
            try:
                points[group] = steps[group].send((loss / n, softmax.unscale(gradient, scales[group]) / n))
            except StopIteration as stop:
                new, losses = stop.value
                delta = np.where(scales[group] > 0, softmax.unscale(new, scales[group]) - old[group], 0.0)
                done[group] = (delta, losses[-1], n)
                del points[group]
    c, f = (a.ravel().astype(np.int32) for a in np.indices(shape))
    tables = [
        pa.table(
            [np.full(d.size, g, np.int64), c, f - 1, d.ravel(), np.full(d.size, loss), np.full(d.size, n, np.int64)],
            names=[by, "class", "feature", "delta", "loss", "rows"],
        )
        for g, (d, loss, n) in done.items()
    ]
    return spark.createDataFrame(pa.concat_tables(tables), f"`{by}` long, {FIT_SCHEMA}")


def _arrays(sums: DataFrame, by: str, shape: tuple[int, int], names: Sequence[str]) -> dict[int, tuple[list[np.ndarray], float, int]]:
    """Arrays, loss and rows per group; one model-sized array per group comes to the driver, within its limit."""
    rows = sums.toArrow()
    groups, c, f, loss, n = (rows[k].to_numpy() for k in (by, "class", "feature", "loss", "rows"))
    out = {}
    for group in np.unique(groups):
        pick = np.flatnonzero(groups == group)
        arrays = [np.zeros(shape) for _ in names]
        for array, name in zip(arrays, names):
            array[c[pick], f[pick] + 1] = rows[name].to_numpy()[pick]
        out[int(group)] = (arrays, float(loss[pick[0]]), int(n[pick[0]]))
    return out


def train_rounds(
    examples: DataFrame,
    weights: np.ndarray | DataFrame,
    rounds: int,
    num_workers: int = NUM_WORKERS,
    *,
    rate: float | None = None,
    iterations: int = LOCAL_ITERATIONS,
    by: str = "shard",
) -> list[np.ndarray] | list[DataFrame]:
    """Weights after 0, 1 ... ``rounds`` rounds in which all workers step together.

    With ``rate`` a worker takes one full-batch step, else a local fit.  Each
    round is one job and starts from plain arrays, so no lineage builds up.

    Weights given as a table give tables, as do arrays whose versions together
    are over the broadcast limit: none is then held by the driver.
    """
    spark = examples.sparkSession
    if isinstance(weights, DataFrame) or (rounds + 1) * weights.size > model.MAX_BROADCAST_WEIGHTS:
        return train_tables(examples, _as_table(spark, weights, by), rounds, num_workers, rate=rate, iterations=iterations, by=by)
    history = [weights]
    bounded = rate is None and groups_are_bounded(examples, by)
    for _ in range(rounds):
        now = history[-1]
        if rate is not None:
            deltas = gradient_step(examples, now, rate, by)
        else:
            deltas = local_fit(examples, now, iterations, by, bounded=bounded)
        history.append(weight_arrays(combine(weights_frame(spark, now), deltas, num_workers)))
    return history


def evaluate(test: DataFrame, weights: np.ndarray | DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weighted F1 and accuracy of one version of the weights, without fitting."""
    return f1_accuracy(predict(test, weights, ("label", *by)), by)


def learning_curve(test: DataFrame, versions: Mapping[int, np.ndarray | DataFrame]) -> DataFrame:
    """F1 and accuracy of several versions; the test rows are read once for as many as fit the broadcast limit."""
    return f1_accuracy(predict_versions(test, versions, ("label",)), ["version"])


def reference_model(examples: DataFrame, **options) -> LogisticRegressionModel:
    """The library's classifier on the whole table, to compare with."""
    rows = examples.select(array_to_vector(F.col("features")).alias("features"), F.col("label").cast("double").alias("label"))
    return LogisticRegression(family="multinomial", **options).fit(rows)


def reference_weights(spark: SparkSession, fitted: LogisticRegressionModel) -> DataFrame:
    """The library's coefficients and intercepts as a table of weights."""
    return weights_frame(spark, np.column_stack([fitted.interceptVector.toArray(), fitted.coefficientMatrix.toArray()]))


def reference_predictions(model: LogisticRegressionModel, examples: DataFrame, *keep: str) -> DataFrame:
    rows = examples.withColumn("features", array_to_vector(F.col("features")))
    return model.transform(rows).select(*keep, "label", F.col("prediction").cast("int").alias("prediction"))
