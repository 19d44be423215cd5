"""The corpus pipeline: toxic documents go, near duplicates go, sources are mixed, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.mixing import mixed_documents
from tidemark.llm.neardup import deduplicated
from tidemark.llm.packing import pack_documents
from tidemark.llm.toxicity import without_toxic
from tidemark.storage import written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of these documents, does not call toxic.

    Null and blank texts are judged by the bias alone, repeated rows alike, rows
    without an id like any other; without labels all stay, an empty table stays empty.
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    That of the smallest id stays; of several rows of an id, the first in text
    order.  Rows without an id and null or blank texts are in no group and stay;
    an empty table stays empty.
    """
    return deduplicated(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    Null sources are one source, null and blank texts have size 0, repeated rows
    are rows of their own, ties in size go by id, then text; an empty table
    stays empty.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and slot of every row.

    Null and blank texts have the end token alone; ties go by id (null first);
    repeated rows have slots of their own; an empty table gives no rows.
    """
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
#: Training a classifier is nothing SQL can say; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over what the one before it wrote to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
