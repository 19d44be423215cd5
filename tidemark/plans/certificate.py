"""How far a model's objective can be from the best one, proved from the model alone.

Coefficients of a softmax model need not be unique, so two right fits cannot be
compared by them.  Their objective can: by duality any chances ``q`` per row
whose mean is the share of each class give a lower bound of it,

    mean entropy of q - |mean of (q - [class = label]) x|^2 / (2 penalty),

and the model's own chances, put right in their means, give a tight one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.scoring import log_loss, margin_arrays, softmax_gradient, softmax_of
from tidemark.storage import dropped, written

CERTIFICATE = "rows long, loss double, objective double, gradient_norm double, lower_bound double, gap double"
NEVER = -1e9  # intercept of a class that has no rows


def certificate(vectors: DataFrame, weights: DataFrame, penalty: float = 0.0) -> DataFrame:
    """One row: mean loss, objective, norm of its gradient, a lower bound of any model's objective, and the gap.

    The objective is the mean cross-entropy plus ``penalty / 2`` times the
    squares of all weights but the intercepts.  ``vectors`` (``row_id, label,
    feature, x``) carries the intercept as feature -1, and labels must be
    classes of ``weights``.  A class without rows is left out of the bound, as
    its best intercept is minus infinity.  Without a penalty there is no
    finite bound by this way: ``lower_bound`` and ``gap`` are NULL.  Without
    rows all but ``rows`` is NULL.  Tables of class and feature stay tables;
    the driver holds one number per class.
    """
    spark = vectors.sparkSession
    vectors = written(vectors.select("row_id", "label", "feature", "x"), "certified")
    counts = {r["label"]: r["count"] for r in vectors.filter("feature = -1").groupBy("label").count().collect()}
    rows = sum(counts.values())
    if not rows:
        dropped(vectors)
        return spark.createDataFrame([(0, None, None, None, None, None)], CERTIFICATE)
    loss = log_loss(vectors, weights).first()["loss"]
    slopes = written(softmax_gradient(vectors, weights), "slopes")
    both = slopes.join(weights, ["class", "feature"], "right").fillna(0.0, ["gradient"])
    inner = F.when(F.col("feature") >= 0, F.col("value")).otherwise(0.0)
    slope = F.col("gradient") / rows + penalty * inner
    size = both.agg(F.sum(inner * inner).alias("squares"), F.sqrt(F.sum(slope * slope)).alias("norm")).first()
    objective = loss + penalty / 2 * size["squares"]
    bound = _lower_bound(vectors, weights, slopes, counts, rows, penalty) if penalty > 0 else None
    dropped(vectors, slopes)
    gap = None if bound is None else objective - bound
    return spark.createDataFrame([(rows, loss, objective, size["norm"], bound, gap)], CERTIFICATE)


def _lower_bound(vectors, weights, slopes, counts, rows, penalty) -> float:
    classes = weights.agg(F.max("class")).first()[0] + 1
    made = []
    share = [counts.get(c, 0) / rows for c in range(classes)]
    if not all(share):
        absent = F.col("class").isin([c for c in range(classes) if not share[c]])
        value = F.when(absent & (F.col("feature") == -1), F.lit(NEVER)).otherwise(F.when(absent, F.lit(0.0)).otherwise(F.col("value")))
        weights = weights.withColumn("value", value)
        slopes = written(softmax_gradient(vectors, weights), "slopes")
        made.append(slopes)
    chances = softmax_of("z")
    entropy = F.aggregate(chances, F.lit(0.0), lambda a, p: a + F.when(p > 0, -p * F.log(p)).otherwise(0.0))
    mean_entropy = margin_arrays(vectors, weights).agg(F.avg(entropy)).first()[0]

    # Mixed with one distribution for all rows, the chances have the shares as their means.
    off = {r["class"]: r["gradient"] / rows for r in slopes.filter("feature = -1").collect()}
    most = max(0.0, *(off[c] / share[c] for c in range(classes) if share[c]))
    mixed = most / (1 + most)
    other = [max(0.0, p - (1 - mixed) / mixed * off[c]) if mixed > 0 else p for c, p in enumerate(share)]
    mean_entropy = (1 - mixed) * mean_entropy - mixed * sum(p * math.log(p) for p in other if p > 0)

    sums = written(vectors.groupBy(F.col("label").cast("int").alias("class"), "feature").agg(F.sum("x").alias("own")), "sums")
    totals = sums.groupBy("feature").agg(F.sum("own").alias("all"))
    cells = slopes.filter("feature >= 0").join(totals, "feature").join(sums, ["class", "feature"], "left")
    chance = F.element_at(F.array(*[F.lit(p) for p in other]), F.col("class") + 1)
    cell = (1 - mixed) * F.col("gradient") + mixed * (chance * F.col("all") - F.coalesce("own", F.lit(0.0)))
    squares = cells.agg(F.coalesce(F.sum(cell * cell), F.lit(0.0))).first()[0] / rows**2
    dropped(sums, *made)
    return mean_entropy - squares / (2 * penalty)
