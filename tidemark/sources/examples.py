"""Labelled rows from CSV files: the last column is the label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.columns import NUM_FEATURES, sparse_map


def example_schema(features: int = NUM_FEATURES, label: str = "Score") -> T.StructType:
    """Columns ``"0"``, ``"1"`` ... and the label."""
    columns = [T.StructField(str(i), T.FloatType()) for i in range(features)]
    return T.StructType([*columns, T.StructField(label, T.IntegerType())])


def read_lines(spark: SparkSession, path: str, *, header: bool = True, stream: bool = False) -> DataFrame:
    """Lines of a CSV file split at the commas, without quoting, as ``fields ARRAY<STRING>``.

    Use it where rows may have any number of fields; check them with
    ``validate_width``.  The CSV reader skips the header line of every file;
    its own separator is set to a control character, so a line stays whole.
    """
    reader = (spark.readStream if stream else spark.read).schema("value string")
    lines = reader.option("header", header).option("sep", "\u0001").option("quote", "").csv(path)
    return lines.select(F.split("value", ",").alias("fields"))


def to_numbers(df: DataFrame, fields: str = "fields", keep: tuple[str, ...] = ()) -> DataFrame:
    """Fields as ``features MAP<INT, FLOAT>`` without zeros, and ``label``."""
    numbers = F.transform(F.slice(fields, 1, F.size(fields) - 1), lambda f: f.cast("float"))
    return df.select(*keep, sparse_map(numbers).alias("features"), F.element_at(fields, -1).cast("int").alias("label"))


def read_examples(
    spark: SparkSession,
    path: str,
    features: int = NUM_FEATURES,
    *,
    label: str = "Score",
    header: bool = True,
    stream: bool = False,
    **options: str,
) -> DataFrame:
    """``features ARRAY<FLOAT>`` and ``label`` with the schema given up front, as a table or a stream."""
    reader = (spark.readStream if stream else spark.read).schema(example_schema(features, label)).options(**options)
    rows = reader.option("header", header).option("quote", "").csv(path)
    return rows.select(F.array(*[_named(str(i)) for i in range(features)]).alias("features"), F.col(label).alias("label"))


def read_inferred(spark: SparkSession, path: str, *, header: bool = True) -> DataFrame:
    """CSV with inferred types; costs a second pass, so prefer :func:`read_examples`."""
    return spark.read.option("header", header).option("inferSchema", True).csv(path)


def _named(column: str) -> Column:
    return F.col(f"`{column}`")
