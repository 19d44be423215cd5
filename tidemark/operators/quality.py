"""Quality of predictions, from counts per class or per (label, prediction)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def confusion(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per label and prediction."""
    return predictions.groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def class_counts(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Support, predicted and correct rows per class; ``n`` is how many rows a row stands for."""
    roles = F.array(
        F.struct(
            F.col("label").alias("class"),
            F.col("n").alias("support"),
            F.lit(0).cast("long").alias("predicted"),
            F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0)).cast("long").alias("correct"),
        ),
        F.struct(
            F.col("prediction").alias("class"),
            F.lit(0).cast("long").alias("support"),
            F.col("n").alias("predicted"),
            F.lit(0).cast("long").alias("correct"),
        ),
    )
    exploded = cells.select(*by, F.inline(roles))
    return exploded.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "correct")])


def _rate(part, whole):
    return F.coalesce(F.col(part) / F.when(F.col(whole) > 0, F.col(whole)), F.lit(0.0))


def _with_rates(counts: DataFrame) -> DataFrame:
    both = F.col("support") + F.col("predicted")
    return counts.withColumns(
        {
            "precision": _rate("correct", "predicted"),
            "recall": _rate("correct", "support"),
            "f1": F.coalesce(2 * F.col("correct") / F.when(both > 0, both), F.lit(0.0)),
        }
    )


def f1_accuracy(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weighted F1 and accuracy, one row per ``by``.

    Rows are counted per class in each task, so what is shuffled is one row
    per class and task.
    """
    rates = _with_rates(class_counts(predictions.withColumn("n", F.lit(1).cast("long")), by))
    total = F.sum("support")
    return rates.groupBy(*by).agg(
        (F.sum(F.col("f1") * F.col("support")) / total).alias("f1"),
        (F.sum("correct") / total).alias("accuracy"),
        total.alias("rows"),
    )


def class_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, then micro, macro and weighted averages."""
    rates = _with_rates(class_counts(confusion(predictions)))
    measures = ("precision", "recall", "f1")
    per_class = rates.select(F.col("class").cast("string").alias("class"), *measures, "support")
    # Micro precision and recall are both the share of correct rows.
    share = F.sum("correct") / F.sum("support")
    shapes = {
        "micro": lambda m: share,
        "macro": F.avg,
        "weighted": lambda m: F.sum(F.col(m) * F.col("support")) / F.sum("support"),
    }
    averages = [
        F.struct(F.lit(name).alias("class"), *[shape(m).alias(m) for m in measures], F.sum("support").alias("support"))
        for name, shape in shapes.items()
    ]
    return per_class.unionByName(rates.agg(F.array(*averages).alias("rows")).select(F.inline("rows")))
