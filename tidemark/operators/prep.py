"""Row preparation: encode, validate, shard, hash, cap and split examples."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from tidemark.functions.columns import BIAS, NUM_FEATURES, NUM_WORKERS, features_of, label_of, sorted_entries, sparse_map
from tidemark.operators.ordered import first_rows
from tidemark.storage import small_side


def sparse_encode(df: DataFrame, values: str, out: str = "features") -> DataFrame:
    """Replace a dense array by a map of its non-zero entries."""
    return df.withColumn(out, sparse_map(values))


def split_label(df: DataFrame, fields: str) -> DataFrame:
    """Last field becomes ``label``, the others ``features``."""
    return df.withColumns({"label": label_of(fields), "features": features_of(fields)}).drop(fields)


def validate_width(df: DataFrame, fields: str, width: int) -> tuple[DataFrame, DataFrame]:
    """Rows with exactly ``width`` fields, and all others (NULL arrays too)."""
    fits = F.coalesce(F.size(F.col(fields)) == width, F.lit(False))
    return df.filter(fits), df.filter(~fits)


def validate_labels(df: DataFrame, label: str, classes: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose label is one of ``0 .. classes - 1``, and all others (NULL labels too)."""
    fits = F.coalesce((F.col(label) >= 0) & (F.col(label) < classes), F.lit(False))
    return df.filter(fits), df.filter(~fits)


def shard_rows(df: DataFrame, id_col: str, n: int = NUM_WORKERS, out: str = "shard") -> DataFrame:
    """Deal rows out to ``n`` shards by their running id."""
    return df.withColumn(out, F.pmod(F.col(id_col), F.lit(n)).cast("long"))


def shard_slice(df: DataFrame, shard: int) -> DataFrame:
    """Rows of one shard; an empty shard is an empty result."""
    return df.filter(F.col("shard") == shard)


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """Numeric columns to one ML vector."""
    return VectorAssembler(inputCols=cols, outputCol=out).transform(df)


def as_examples(df: DataFrame, features: str, label: str, *keep: str) -> DataFrame:
    """Two columns named ``features`` and ``label``, plus any ids to keep."""
    return df.select(*keep, F.col(features).alias("features"), F.col(label).cast("int").alias("label"))


def feature_entries(df: DataFrame, features: str = "features") -> DataFrame:
    """Sorted index and value arrays of a feature map."""
    entries = sorted_entries(features)
    return df.withColumns({"indices": entries["key"], "values": entries["value"]})


def to_sparse_vector(df: DataFrame, features: str, width: int, out: str = "vector") -> DataFrame:
    """Feature map to an ML vector of ``width`` entries, stored sparse where that is smaller.

    A row costs what its entries cost, whatever the width.  Keys outside
    ``[0, width)`` are left out; a NULL map is a vector of zeros.
    """
    inside = lambda e: (e["value"] != 0) & (e["key"] >= 0) & (e["key"] < width)
    entries = F.array_sort(F.filter(F.map_entries(F.coalesce(features, F.create_map().cast(df.schema[features].dataType))), inside))
    rows = df.withColumns({"_keys": entries["key"].cast("array<int>"), "_values": entries["value"].cast("array<double>")})

    def build(batches):
        for batch in batches:
            keys, values = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], vectors_of(keys, values, width)], names=[*batch.schema.names[:-2], out])

    return rows.mapInArrow(build, T.StructType([*df.schema.fields, T.StructField(out, VectorUDT())]))


def vectors_of(keys: pa.ListArray, values: pa.ListArray, width: int) -> pa.StructArray:
    """Sorted keys and values as the rows of a vector column: type (0 sparse, 1 dense), size, indices, values."""
    counts = np.diff(keys.offsets.to_numpy())
    dense = 1.5 * (counts + 1) >= width  # the size at which a dense row is no larger
    if dense.any():
        spread = [v if not full else np.zeros(width) for v, full in zip(values.to_numpy(zero_copy_only=False), dense)]
        for row, at, v, full in zip(spread, keys.to_numpy(zero_copy_only=False), values.to_numpy(zero_copy_only=False), dense):
            if full:
                row[np.asarray(at, dtype=np.int64)] = v
        values = pa.array(spread, pa.list_(pa.float64()))
        keys = pa.array([None if full else k for k, full in zip(keys.to_numpy(zero_copy_only=False), dense)], pa.list_(pa.int32()))
    sizes = pa.array([None if full else width for full in dense], pa.int32())
    return pa.StructArray.from_arrays([pa.array(dense.astype(np.int8)), sizes, keys, values], names=["type", "size", "indices", "values"])


def long_vectors(df: DataFrame, *keep: str, features: str = "features", bias: bool = False) -> DataFrame:
    """One row per feature: ``feature`` counts from 0, the intercept is feature -1 with x = 1.

    ``features`` may be an array or a map.
    """
    if df.schema[features].dataType.typeName() == "map":
        entries = F.transform(
            F.map_entries(features), lambda e: F.struct(e["key"].cast("int").alias("feature"), e["value"].cast("double").alias("x"))
        )
    else:
        entries = F.transform(features, lambda x, i: F.struct(i.cast("int").alias("feature"), x.cast("double").alias("x")))
    if bias:
        first = F.array(F.struct(F.lit(BIAS).cast("int").alias("feature"), F.lit(1.0).alias("x")))
        entries = F.concat(first, entries)
    return df.select(*keep, F.inline(entries))


def in_key_range(df: DataFrame, key: str, start: int, end: int) -> DataFrame:
    """Keys in ``[start, end)``."""
    return df.filter((F.col(key) >= start) & (F.col(key) < end))


def cast_label(df: DataFrame, label: str, type_name: str) -> DataFrame:
    """Labels as another type, e.g. ``double`` for the evaluator or ``string`` for a report."""
    return df.withColumn(label, F.col(label).cast(type_name))


def tokens(text: Column | str) -> Column:
    """Lower-cased words: runs of anything but white space."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(text), "[ \\t\\n\\r\\f]+"), lambda t: t != "")


def token_buckets(text: Column | str, buckets: int = NUM_FEATURES) -> Column:
    """Sorted ``ARRAY<STRUCT<feature, x>>`` of a text's term counts, made inside the row.

    bucket = first 8 hex digits of a token's md5 mod ``buckets``.  A word is
    hashed once per task and its repeats are counted; texts come and counts go
    in Arrow batches.  A NULL or blank text has an empty array.
    """
    text = F.col(text) if isinstance(text, str) else text
    return _term_counts(buckets)(F.lower(text))


TERMS = "array<struct<feature: int, x: bigint>>"
KNOWN_WORDS = 200_000  # words whose bucket a worker remembers
_WORD = re.compile("[^ \t\n\r\f]+")


class _Buckets(dict):
    """Bucket by word."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        made = self[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.buckets
        return made


@cache
def _bucket_of(buckets: int) -> _Buckets:
    """This process's memory of buckets."""
    return _Buckets(buckets)


@cache
def _term_counts(buckets: int):
    @F.arrow_udf(TERMS)
    def term_counts(texts: pa.Array) -> pa.Array:
        bucket_of, ends, features, counts = _bucket_of(buckets), [0], [], []
        for text in texts.to_pylist():
            found: dict[int, int] = {}
            for word, times in Counter(_WORD.findall(text or "")).items():
                bucket = bucket_of[word]
                found[bucket] = found.get(bucket, 0) + times
            for bucket in sorted(found):
                features.append(bucket)
                counts.append(found[bucket])
            ends.append(len(features))
        entries = pa.StructArray.from_arrays([pa.array(features, pa.int32()), pa.array(counts, pa.int64())], names=["feature", "x"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)

    return term_counts


def hash_text(df: DataFrame, text: str, id_col: str, buckets: int = NUM_FEATURES) -> DataFrame:
    """Term counts per hash bucket in long form; whole texts, counted in their row, nothing is shuffled."""
    return df.select(id_col, F.inline(token_buckets(text, buckets)))


def hashed_maps(df: DataFrame, text: str, id_col: str, buckets: int = NUM_FEATURES) -> DataFrame:
    """One row per text with its term counts as ``features``; a blank or NULL text has an empty map."""
    entries = F.transform(token_buckets(text, buckets), lambda e: F.struct(e["feature"].alias("key"), e["x"].cast("float").alias("value")))
    return df.select(id_col, F.map_from_entries(entries).alias("features"))


def hashed_vectors(df: DataFrame, text: str, buckets: int = NUM_FEATURES, out: str = "features") -> DataFrame:
    """Term counts as an ML vector with the library's own hash."""
    words = df.withColumn("_words", tokens(text))
    return HashingTF(numFeatures=buckets, inputCol="_words", outputCol=out).transform(words).drop("_words")


def cap_per_label(df: DataFrame, label: str, id_col: str, k: int) -> DataFrame:
    """At most ``k`` rows of every label (NULL is one), in the order of the md5 of the id.

    Few labels means hot labels, so the rows are not sorted per label.  They
    are counted per label and leading 16 bits of the hash; the bucket in which
    the k-th row falls is found on those counts, and only rows up to it are
    ranked.
    """
    hashed = df.withColumn("_h", F.md5(F.col(id_col).cast("string"))).withColumn("_bucket", F.substring("_h", 1, 4))
    counts = hashed.groupBy(label, "_bucket").count()
    earlier = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        counts.withColumn("_before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
        .filter(F.col("_before") < k)
        .groupBy(F.col(label).alias("_label"))
        .agg(F.max("_bucket").alias("_last"))
    )
    near = hashed.join(small_side(last), F.col(label).eqNullSafe(F.col("_label")) & (F.col("_bucket") <= F.col("_last")))
    return first_rows(near, [label], ["_h", id_col], k).select(*df.columns)


def preview(df: DataFrame, n: int, id_col: str) -> DataFrame:
    """``n`` rows picked by the hash of their id, the same ones every time."""
    return df.orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(n)


def split(df: DataFrame, id_col: str, test_share: float) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the id; a row never changes sides."""
    slot = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long") % 10_000
    test = slot < round(test_share * 10_000)
    return df.filter(~test), df.filter(test)


def label_histogram(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per label."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
