"""The shared model as a table ``(class, feature, value)``; the intercept is feature -1."""

from __future__ import annotations

import numpy as np
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.columns import BIAS
from tidemark.operators.ordered import Running, running
from tidemark.storage import small_side

KEY = ["class", "feature"]
MAX_BROADCAST_WEIGHTS = 10_000_000
GAP_PIECE = 1 << 20  # ids one row of a gap stands for at most before they are listed


def init_weights(spark: SparkSession, classes: int, features: int) -> DataFrame:
    """Zero for every class and feature, intercepts included."""
    return spark.range(classes).select(
        F.col("id").cast("int").alias("class"),
        F.explode(F.sequence(F.lit(BIAS), F.lit(features - 1))).alias("feature"),
        F.lit(0.0).alias("value"),
    )


def init_weights_for(examples: DataFrame, label: str = "label", features: str = "features") -> DataFrame:
    """Zero weights for the label range and the width found in ``examples``."""
    extent = examples.agg(F.max(label).alias("top"), F.max(F.size(features)).alias("width"))
    classes = extent.select(F.explode(F.sequence(F.lit(0), F.col("top").cast("int"))).alias("class"), "width")
    return classes.select("class", F.explode(F.sequence(F.lit(BIAS), F.col("width") - 1)).alias("feature"), F.lit(0.0).alias("value"))


def to_flat(weights: DataFrame, classes: int, features: int, value: str = "value") -> DataFrame:
    """Flat key: coefficients class by class within a feature, then the intercepts."""
    key = F.when(F.col("feature") == BIAS, F.lit(classes * features) + F.col("class")).otherwise(
        F.col("feature") * classes + F.col("class")
    )
    return weights.select(key.cast("int").alias("key"), value)


def from_flat(flat: DataFrame, classes: int, features: int, value: str = "value") -> DataFrame:
    """Inverse of :func:`to_flat`."""
    bias = F.col("key") >= classes * features
    return flat.select(
        F.when(bias, F.col("key") - classes * features).otherwise(F.col("key") % classes).cast("int").alias("class"),
        F.when(bias, F.lit(BIAS)).otherwise(F.floor(F.col("key") / classes)).cast("int").alias("feature"),
        value,
    )


def settle(weights: DataFrame) -> DataFrame:
    """Evaluate a weights table once."""
    return small_side(weights)


def weight_arrays(weights: DataFrame, by: str | None = None, also: str | None = None) -> dict | np.ndarray | tuple[dict, dict]:
    """``(classes, features + 1)`` array, or one per value of ``by``; bounded by the broadcast limit.

    ``also`` names a column with one value per group, given as a second dict.
    """
    rows = weights.limit(MAX_BROADCAST_WEIGHTS + 1).toArrow()
    if rows.num_rows > MAX_BROADCAST_WEIGHTS:
        raise ValueError("model too large for one process; use the table form (margins, softmax_gradient)")
    c, f = rows["class"].to_numpy(), rows["feature"].to_numpy() + 1
    v = rows["value"].to_numpy()
    shape = (int(c.max()) + 1, int(f.max()) + 1)
    if by is None:
        out = np.zeros(shape)
        out[c, f] = v
        return out
    groups = rows[by].to_numpy()
    arrays = {}
    for g in np.unique(groups):
        pick = groups == g
        arrays[int(g)] = np.zeros(shape)
        arrays[int(g)][c[pick], f[pick]] = v[pick]
    if also is None:
        return arrays
    values = rows[also].to_numpy()
    return arrays, {g: values[np.flatnonzero(groups == g)[0]] for g in arrays}


def weights_frame(spark: SparkSession, array: np.ndarray) -> DataFrame:
    """Inverse of :func:`weight_arrays` for one model."""
    import pyarrow as pa

    c, f = np.indices(array.shape)
    table = pa.table(
        {
            "class": pa.array(c.ravel().astype(np.int32)),
            "feature": pa.array((f.ravel() - 1).astype(np.int32)),
            "value": pa.array(array.ravel().astype(np.float64)),
        }
    )
    return spark.createDataFrame(table)


def to_ml(weights: DataFrame) -> tuple[DenseMatrix, object]:
    """Coefficient matrix and intercept vector in the ML library's types."""
    w = weight_arrays(weights)
    coefficients = w[:, 1:]
    matrix = DenseMatrix(coefficients.shape[0], coefficients.shape[1], coefficients.ravel(order="F").tolist())
    return matrix, Vectors.dense(w[:, 0].tolist())


def match_delta(weights: DataFrame, deltas: DataFrame) -> DataFrame:
    """Every delta next to the weight it belongs to; the log stays where it is if the model is small."""
    return deltas.join(settle(weights), KEY)


def combine(weights: DataFrame, deltas: DataFrame, n: int) -> DataFrame:
    """Add the workers' deltas, each divided by ``n``; keys without a delta stay."""
    total = deltas.groupBy(*KEY).agg(F.sum("delta").alias("_total"))
    return weights.join(total, KEY, "left").select(
        *KEY, (F.col("value") + F.coalesce(F.col("_total"), F.lit(0.0)) / n).alias("value")
    )


def upsert_weights(old: DataFrame, new: DataFrame) -> DataFrame:
    """New values win, all other keys stay."""
    o, n = old.alias("o"), new.alias("n")
    return o.join(n, KEY, "full_outer").select(*KEY, F.coalesce("n.value", "o.value").alias("value"))


def closing_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """New minus old; a key the local model lacks has delta 0."""
    o, n = old.alias("o"), new.alias("n")
    return o.join(n, KEY, "left").select(
        *KEY, (F.coalesce(F.col("n.value"), F.col("o.value")) - F.col("o.value")).alias("delta")
    )


def key_extent(flat: DataFrame, key: str = "key") -> DataFrame:
    """Smallest key and one past the largest; (0, 1) for an empty model."""
    return flat.agg(
        F.coalesce(F.min(key), F.lit(0)).cast("int").alias("start"),
        (F.coalesce(F.max(key), F.lit(0)) + 1).cast("int").alias("end"),
    )


def collect_weights(weights: DataFrame, by: str = "class", key: str = "feature", value: str = "value") -> DataFrame:
    """One map per ``by``; its size is the number of keys in the model, not of rows in the data."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key), F.col(value))))
    return weights.groupBy(by).agg(F.map_from_entries(entries).alias("values"))


def weight_history(
    weights: DataFrame, deltas: DataFrame, n: int, arrival: list[str], rows_per_task: int | None = None
) -> DataFrame:
    """Value of every key after each delta, in arrival order.

    A key touched by every delta has as many rows as the log has deltas, so
    the running sum is cut into ranges when a key is that hot.
    """
    summed = running(deltas, KEY, arrival, {"_sum": Running("sum", F.col("delta"))}, rows_per_task=rows_per_task)
    return summed.join(settle(weights), KEY).withColumn("value", F.col("value") + F.col("_sum") / n).drop("_sum")


def missing_ids(df: DataFrame, id_col: str, low: int, high: int, piece: int = GAP_PIECE) -> DataFrame:
    """Ids of ``[low, high]`` that ``df`` does not hold; only gaps between neighbours are filled.

    A gap is split into blocks of ``piece`` pieces of ``piece`` ids, and the
    pieces are dealt out before their ids are listed, so neither an array nor
    a task grows with a gap.
    """
    held = df.select(F.col(id_col).cast("long").alias("_id")).filter(F.col("_id").between(low, high)).distinct()
    ends = df.sparkSession.range(1).select(F.explode(F.array(F.lit(low - 1), F.lit(high + 1)).cast("array<long>")).alias("_id"))
    next_id = running(held.union(ends).select((-F.col("_id")).alias("_down"), "_id"), [], ["_down"], {"_next": Running("last", F.col("_id"), current=False)})
    gaps = next_id.filter("_next > _id + 1").select((F.col("_id") + 1).alias("_from"), (F.col("_next") - 1).alias("_to"))
    for step in (piece * piece, piece):
        starts = gaps.select("_to", F.explode(F.sequence("_from", "_to", F.lit(step).cast("long"))).alias("_from"))
        # A stated number of partitions is kept: Spark would join them again, as the rows are few.
        dealt = starts.select("_from", (F.col("_from") + F.least(F.lit(step - 1), F.col("_to") - F.col("_from"))).alias("_to"))
        gaps = dealt.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_from")
    return gaps.select(F.explode(F.sequence("_from", "_to")).alias(id_col))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that are not in ``b``."""
    return a.subtract(b)
