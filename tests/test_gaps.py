"""Ids missing from sparse tables."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.weights import missing_ids


@pytest.mark.parametrize("piece", [1, 2, 3, 1 << 20])
def test_gaps_are_whole_whatever_the_piece(spark, piece):
    held = [0, 1, 5, 27, 28, 30, 79]
    got = missing_ids(spark.createDataFrame([(i,) for i in held], "id long"), "id", -4, 100, piece)
    assert got.columns == ["id"] and sorted(r[0] for r in got.collect()) == [i for i in range(-4, 101) if i not in held]


def test_a_gap_wider_than_an_array(spark):
    ids = spark.createDataFrame([(0,), (1 << 33,)], "id long")
    assert len(missing_ids(ids, "id", 0, 1 << 33).limit(5).collect()) == 5


def test_a_wide_gap_is_shared_by_tasks(spark):
    ids = spark.createDataFrame([(0,), (100_000,)], "id long")
    tasks = missing_ids(ids, "id", 0, 100_000, 1_000).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 99_999 and max(r["count"] for r in tasks) < 60_000
