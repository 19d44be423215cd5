"""Margins, gradients and predictions of a softmax model.

Two forms of each:

* table form (``margins``, ``softmax_gradient``): features joined with weights,
  for sparse rows and for models of any size;
* block form (``predict``, ``gradient_sums``): rows stay where they are, the
  weights travel to them, and every task sends back one partial sum per shard
  and key.  ``predict`` takes the table form beyond the broadcast limit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import softmax
from tidemark.operators import weights as model
from tidemark.operators.prep import long_vectors
from tidemark.storage import small_side, written

ROWS_PER_BLOCK, BLOCK_VALUES = 4096, 4_194_304  # a dense block holds at most so many rows and values
FLUSH_VALUES = 4_000_000  # partial sums one task holds before it passes them on


# ---- table form -----------------------------------------------------------


def _feature_weights(weights: DataFrame) -> tuple[DataFrame, list[int]]:
    """One row per feature with one weight column per class, and the classes."""
    weights = small_side(weights)
    classes = list(range(weights.agg(F.max("class")).first()[0] + 1))
    wide = weights.groupBy("feature").agg(
        *[F.coalesce(F.max(F.when(F.col("class") == c, F.col("value"))), F.lit(0.0)).alias(f"_w{c}") for c in classes]
    )
    return small_side(wide), classes


def margin_arrays(vectors: DataFrame, weights: DataFrame, row: str = "row_id", keep: Sequence[str] = ("label",)) -> DataFrame:
    """Array of margins per row, one entry per class; ``vectors`` must carry the bias feature."""
    wide, classes = _feature_weights(weights)
    sums = [F.sum(F.col("x") * F.col(f"_w{c}")).alias(f"_z{c}") for c in classes]
    rows = vectors.join(wide, "feature").groupBy(row, *keep).agg(*sums)
    return rows.select(row, *keep, F.array(*[f"_z{c}" for c in classes]).alias("z"))


def margins(vectors: DataFrame, weights: DataFrame, row: str = "row_id", keep: Sequence[str] = ("label",)) -> DataFrame:
    """Margin of every row and class in long form."""
    z = margin_arrays(vectors, weights, row, keep)
    return z.select(row, *keep, F.posexplode("z").alias("class", "z"))


def softmax_of(z: Column | str) -> Column:
    """Class probabilities from an array of margins."""
    z = F.col(z) if isinstance(z, str) else z
    top = F.array_max(z)
    e = F.transform(z, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def best_class(z: Column | str) -> Column:
    """Class with the largest margin; the lowest one on a tie."""
    z = F.col(z) if isinstance(z, str) else z
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def cross_entropy(z: Column | str, label: Column | str) -> Column:
    """Negative log-probability of the label."""
    z = F.col(z) if isinstance(z, str) else z
    label = F.col(label) if isinstance(label, str) else label
    top = F.array_max(z)
    total = F.aggregate(z, F.lit(0.0), lambda a, v: a + F.exp(v - top))
    return top + F.log(total) - F.element_at(z, label + 1)


def softmax_gradient(vectors: DataFrame, weights: DataFrame, row: str = "row_id", by: Sequence[str] = ()) -> DataFrame:
    """Sum over rows of (probability - [class = label]) * x per class and feature.

    Margins are added up per row, the residuals are worked out once per row
    and joined back to its features.  Row ids are spread evenly, and the sum
    per key is reduced in each task before it is shuffled.
    """
    wide, classes = _feature_weights(weights)
    sums = [F.sum(F.col("x") * F.col(f"_w{c}")).alias(f"_z{c}") for c in classes]
    rows = vectors.join(wide, "feature").groupBy(row).agg(F.max("label").alias("_label"), *sums)
    hit = F.transform(F.array(*[F.lit(c) for c in classes]), lambda c: F.when(c == F.col("_label"), 1.0).otherwise(0.0))
    residual = F.zip_with(softmax_of(F.array(*[f"_z{c}" for c in classes])), hit, lambda p, h: p - h)
    # The exploded vectors are far larger than Spark takes them for; they must not be broadcast.
    p = vectors.join(rows.select(row, residual.alias("_r")).hint("merge"), row)
    parts = [F.sum(F.get("_r", F.lit(i)) * F.col("x")).alias(f"_g{c}") for i, c in enumerate(classes)]
    sums = p.groupBy(*by, "feature").agg(*parts)
    cells = F.array(*[F.struct(F.lit(c).cast("int").alias("class"), F.col(f"_g{c}").alias("gradient")) for c in classes])
    return sums.select(*by, "feature", F.inline(cells)).select(*by, "class", "feature", "gradient")


def log_loss(vectors: DataFrame, weights: DataFrame, row: str = "row_id", by: Sequence[str] = ()) -> DataFrame:
    """Mean cross-entropy."""
    z = margin_arrays(vectors, weights, row, ("label", *by))
    return z.groupBy(*by).agg(F.avg(cross_entropy("z", "label")).alias("loss"))


# ---- block form -----------------------------------------------------------


def row_blocks(batch: pa.RecordBatch, width: int):
    """A batch in pieces that stay small as dense blocks, however wide the rows are."""
    rows = max(1, min(ROWS_PER_BLOCK, BLOCK_VALUES // (width + 1)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def predict(examples: DataFrame, weights: np.ndarray | DataFrame, keep: Sequence[str] = ("row_id", "label")) -> DataFrame:
    """Predicted class of every row, without moving rows; weights given as a table, or over the limit, are joined."""
    return predict_versions(examples, {0: weights}, keep).drop("version")


def predict_versions(
    examples: DataFrame, versions: Mapping[int, np.ndarray | DataFrame], keep: Sequence[str] = ("row_id", "label")
) -> DataFrame:
    """Predictions under several versions of the weights: ``version``, the ``keep`` columns and ``prediction``.

    The product of rows and versions is made block by block.  Arrays go to the
    rows, as many versions in one pass as the broadcast limit takes; no
    broadcast grows with their number.  A version that is a table, or an array
    over the limit, is joined to the rows by feature, and margins are added up
    over the features.  Versions must have one width.
    """
    passes: list[dict[int, np.ndarray]] = []
    tables: dict[int, DataFrame] = {}
    held = 0
    for version, weights in versions.items():
        if isinstance(weights, DataFrame):
            tables[version] = weights
        elif weights.size > model.MAX_BROADCAST_WEIGHTS:
            tables[version] = model.weights_frame(examples.sparkSession, weights)
        else:
            if not passes or held + weights.size > model.MAX_BROADCAST_WEIGHTS:
                passes.append({})
                held = 0
            passes[-1][version] = weights
            held += weights.size
    parts = [_predict_in_place(examples, some, keep) for some in passes]
    if tables:
        parts.append(_predict_by_join(examples, tables, keep))
    return reduce(DataFrame.unionByName, parts)


def _predict_in_place(examples, versions, keep) -> DataFrame:
    width = next(iter(versions.values())).shape[1] - 1
    models = examples.sparkSession.sparkContext.broadcast(versions)
    narrow = examples.select(*keep, "features")

    def score(batches):
        for batch in batches:
            for part in row_blocks(batch, width):
                x = softmax.with_bias(softmax.dense_block(part.column("features"), width))
                for version, w in models.value.items():
                    best = softmax.margins(x, w).argmax(axis=1).astype(np.int32)
                    number = pa.array(np.full(len(best), version, dtype=np.int64))
                    columns = [part.column(c) for c in keep]
                    yield pa.RecordBatch.from_arrays([number, *columns, pa.array(best)], names=["version", *keep, "prediction"])

    return narrow.mapInArrow(score, f"version long, {_fields(examples, keep)}, prediction int")


def _predict_by_join(examples, versions, keep) -> DataFrame:
    """Each row is numbered and written once, so that its features find together again."""
    numbered = written(examples.select(*keep, "features", F.monotonically_increasing_id().alias("_row")), "rows")
    vectors = long_vectors(numbered, "_row", bias=True)
    parts = []
    for version, weights in versions.items():
        z = margin_arrays(vectors, weights, "_row", keep=())
        parts.append(z.select("_row", F.lit(version).cast("long").alias("version"), best_class("z").alias("prediction")))
    return numbered.drop("features").join(reduce(DataFrame.unionByName, parts), "_row").select("version", *keep, "prediction")


def _fields(examples: DataFrame, keep: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {examples.schema[c].dataType.simpleString()}" for c in keep)


def _sums_per_group(examples: DataFrame, by: str, width: int, models, measure, measures: Sequence[str]) -> DataFrame:
    """Reduce the rows of every group to arrays of one shape and add them up over all tasks.

    ``measure(x, labels, model)`` gives one array per name in ``measures`` and
    a loss for a block of rows.  A hot group is no problem: each task reduces
    its own rows first and sends one array per group.
    """
    shared = not isinstance(models, dict)
    sent = examples.sparkSession.sparkContext.broadcast(models)
    narrow = examples.select(F.col(by).cast("long").alias(by), F.col("label").cast("int").alias("label"), "features")
    names = [by, "class", "feature", *measures, "loss", "rows"]

    def emit(group, arrays, loss, rows):
        c, f = (a.ravel().astype(np.int32) for a in np.indices(arrays[0].shape))
        columns = [np.full(c.size, group, np.int64), c, f - 1, *[a.ravel() for a in arrays]]
        columns += [np.full(c.size, loss), np.full(c.size, rows, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in columns], names=names)

    def reduce(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for part in row_blocks(batch, width):
                groups = part.column(by).to_numpy(zero_copy_only=False)
                labels = part.column("label").to_numpy(zero_copy_only=False)
                x = softmax.with_bias(softmax.dense_block(part.column("features"), width))
                for group in np.unique(groups):
                    w = sent.value if shared else sent.value.get(int(group))
                    if w is None and not shared:
                        continue
                    pick = groups == group
                    arrays, loss = measure(x[pick], labels[pick], w)
                    old = sums.setdefault(int(group), [[0.0] * len(arrays), 0.0, 0])
                    old[0] = [a + b for a, b in zip(old[0], arrays)]
                    old[1] += loss
                    old[2] += int(pick.sum())
                held = sum(a.size for arrays, _, _ in sums.values() for a in arrays)
                if held > FLUSH_VALUES:
                    for group, value in sums.items():
                        yield emit(group, *value)
                    sums = {}
        for group, value in sums.items():
            yield emit(group, *value)

    doubles = ", ".join(f"{m} double" for m in measures)
    parts = narrow.mapInArrow(reduce, f"`{by}` long, class int, feature int, {doubles}, loss double, rows long")
    return parts.groupBy(by, "class", "feature").agg(*[F.sum(m).alias(m) for m in (*measures, "loss", "rows")])


def gradient_sums(examples: DataFrame, weights: np.ndarray | dict[int, np.ndarray], by: str = "shard") -> DataFrame:
    """Summed gradient, summed loss and rows per ``by``, class and feature.

    ``weights`` is one model for all, or one per value of ``by``; groups
    without a model are left out.
    """
    width = (next(iter(weights.values())) if isinstance(weights, dict) else weights).shape[1] - 1

    def measure(x, labels, w):
        loss, gradient = softmax.loss_and_gradient(x, labels, w)
        return [gradient], loss

    return _sums_per_group(examples, by, width, weights, measure, ["gradient"])


def moment_sums(examples: DataFrame, width: int, by: str = "shard") -> DataFrame:
    """Sum and sum of squares of every feature and rows per ``by``; class is 0 throughout."""

    def measure(x, labels, w):
        return [x.sum(axis=0)[None, :], (x * x).sum(axis=0)[None, :]], 0.0

    return _sums_per_group(examples, by, width, None, measure, ["total", "squares"])


def gradient_step(examples: DataFrame, weights: np.ndarray | dict[int, np.ndarray], rate: float, by: str = "shard") -> DataFrame:
    """One full-batch step per group: delta = -rate * mean gradient, with the mean loss before the step."""
    sums = gradient_sums(examples, weights, by)
    return sums.select(
        by,
        "class",
        "feature",
        (-rate * F.col("gradient") / F.col("rows")).alias("delta"),
        (F.col("loss") / F.col("rows")).alias("loss"),
        "rows",
    )
