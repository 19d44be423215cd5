"""Toxicity of whole documents, learned from labelled rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.subwords import BUCKETS, SubwordSoftmax
from tidemark.llm.tasks import give_back_memory, map_batches, map_stream
from tidemark.storage import ship_package

FOLDS = 5
MODEL = ("vectors", "weights", "bias")
TRAIN_ROWS = (4_000, 2_000)  # at most so many rows of class 0 and of class 1 are fitted
TRAIN_CHARS = 10_000  # labelled texts longer than this are not fitted; all are scored


def fold_of(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> SubwordSoftmax:
    """Fit on a bounded sample of labelled rows outside fold 0.

    Per class the ``rows`` ids with the smallest hash are taken, so the sample
    is the same in every run and at most ``sum(rows) * chars`` characters reach
    the one task that fits; the driver gets the model.  An id with several
    labels counts as toxic if any says so.
    """
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = docs.filter(F.char_length("text") <= chars).select("doc_id").join(marked.filter(fold_of("doc_id") != 0), "doc_id").distinct()
    chosen = None
    for label, most in enumerate(rows):
        own = usable.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = own if chosen is None else chosen.union(own)
    texts = docs.filter(F.char_length("text") <= chars).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def train(batches):
        rows = pa.Table.from_batches(batches, schema=arrow).sort_by("doc_id")
        model = SubwordSoftmax.fit(rows["text"].to_pylist(), rows["toxic"].to_pylist())
        yield {name: [getattr(model, name).tobytes()] for name in MODEL} | {"fitted": [model.fitted]}
        del rows, model
        give_back_memory()

    sample = sample.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
    arrow = to_arrow_schema(sample.schema)
    made = map_stream(sample.repartition(1), train, ", ".join(f"{name} binary" for name in MODEL) + ", fitted boolean").first()
    if made is None:  # Spark runs no task on a sample that it knows to be empty
        return SubwordSoftmax.fit([], [])
    vectors, weights, bias = (np.frombuffer(made[name], dtype=np.float32) for name in MODEL)
    return SubwordSoftmax(vectors.reshape(BUCKETS, -1), weights.reshape(-1, 2), bias, made["fitted"])


def scored(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document, from its text alone.

    ``held_out`` marks fold 0, whose labels the fit never sees (a null id is in
    no fold).  Null and blank texts get the score of the bias.  Repeated rows
    give rows of their own, an empty table none; other columns play no part;
    without labelled rows every score is one half.
    """
    docs = docs.select("doc_id", "text")
    model = fit(docs, labels, **options)

    def work(batch):
        scores = [model.score(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    rows = docs.withColumn("held_out", F.coalesce(fold_of("doc_id") == 0, F.lit(False)))
    return map_batches(rows, work, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns, whatever these are called.

    Null and blank texts get the score of the bias and stay where it is below
    one half; repeated rows stay or go together; rows without an id are judged
    like any other.  Without labelled rows every score is one half: that is no
    verdict, and all documents stay.  An empty table stays empty.
    """
    ship_package(docs.sparkSession)
    model = fit(docs.select("doc_id", "text"), labels, **options)
    if not model.fitted:
        return docs
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            clean = np.array([model.score(t) < 0.5 for t in batch.column(at).to_pylist()], dtype=bool)
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
