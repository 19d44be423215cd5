"""Mixing where very many rows share one key."""

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA
from tidemark.llm.mixing import mix_documents, mixed_documents


@pytest.fixture
def dealt(spark):
    """Partitions stay as they were dealt, and nothing is broadcast."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rows_without_an_id_are_not_one_task(spark, dealt):
    blank = spark.range(4_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    tasks = mixed_documents(blank).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 4_000
    assert max(r["count"] for r in tasks) < 2_000


def test_rows_that_share_a_key_are_taken_as_often_as_the_mix_says(spark):
    rows = [(None, f"t{i % 7} word", "en", "ab"[i % 2], 7) for i in range(300)] + [(i, "one two three", "en", "c", 13) for i in range(500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {tuple(r) for r in mix_documents(docs).groupBy("doc_id", "source", "size").agg(F.sum("copies")).filter("sum(copies) > 0").select("doc_id", "source", "sum(copies)").collect()}
    assert {tuple(r) for r in mixed_documents(docs).groupBy("doc_id", "source").count().collect()} == want
