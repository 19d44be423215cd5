"""Small helpers for work inside Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.storage import ship_package

ROWS = 512  # of a batch that are Python objects at one time


def give_back_memory() -> None:
    """Hand freed memory back to the system, so that a worker that goes on does not keep the peak of one task."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: T.StructType | str) -> DataFrame:
    """Columns that ``work`` makes of each batch (a dict by column name, of lists or arrays), a few rows at a time."""

    def pieces(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield work(batch.slice(at, ROWS))

    return map_stream(df, pieces, schema)


def map_stream(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: T.StructType | str) -> DataFrame:
    """The same over a task's whole stream of batches."""
    ship_package(df.sparkSession)
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
