"""Tagged JSON messages: one object per record, its type in the field ``_t``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

TAG = "_t"
FAULT = "_fault"  # holds a record that does not fit its schema

KEY_RANGE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_MODEL_MESSAGE = [
    T.StructField("vectorClock", T.IntegerType()),
    T.StructField("keyRange", KEY_RANGE),
    T.StructField("values", T.MapType(T.IntegerType(), T.FloatType())),
]

# Type tags and field names of the message format.
LABELED, LABELED_WITH_AGE, WEIGHTS, GRADIENT, KEY_RANGE_TAG = "LabeledData", "LabeledDataWithAge", "wMsg", "gMsg", "keyRange"
SCHEMAS: dict[str, T.StructType] = {
    LABELED: T.StructType(
        [T.StructField("inputData", T.MapType(T.IntegerType(), T.FloatType())), T.StructField("label", T.IntegerType())]
    ),
    LABELED_WITH_AGE: T.StructType(
        [
            T.StructField("inputFeatures", T.MapType(T.IntegerType(), T.FloatType())),
            T.StructField("label", T.IntegerType()),
            T.StructField("insertionID", T.LongType()),
        ]
    ),
    WEIGHTS: T.StructType(_MODEL_MESSAGE),
    GRADIENT: T.StructType([*_MODEL_MESSAGE, T.StructField("partitionKey", T.LongType())]),
    KEY_RANGE_TAG: KEY_RANGE,
}


def tagged(tag: str, **fields: Column) -> Column:
    """A struct that starts with its type tag."""
    return F.struct(F.lit(tag).alias(TAG), *[c.alias(name) for name, c in fields.items()])


def key_range(start: Column, end: Column) -> Column:
    return tagged(KEY_RANGE_TAG, start=start, end=end)


def encode(message: Column) -> Column:
    """Struct to JSON text; a NULL message stays NULL."""
    return F.when(message.isNotNull(), F.to_json(message))


def labeled(features: Column, label: Column) -> Column:
    return tagged(LABELED, inputData=features, label=label)


def weights_message(clock: Column, start: Column, end: Column, values: Column) -> Column:
    return tagged(WEIGHTS, vectorClock=clock, keyRange=key_range(start, end), values=values)


def gradient_message(clock: Column, start: Column, end: Column, values: Column, worker: Column) -> Column:
    return tagged(GRADIENT, vectorClock=clock, keyRange=key_range(start, end), values=values, partitionKey=worker)


def _text_keys(kind: T.DataType) -> T.DataType:
    """The same type with STRING map keys, which is all JSON has."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _text_keys(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.MapType):
        return T.MapType(T.StringType(), _text_keys(kind.valueType))
    return kind


def decode(df: DataFrame, value: str = "value", schemas: dict[str, T.StructType] | None = None, strict: bool = True) -> DataFrame:
    """Add ``tag`` and one struct column per type, NULL for rows of another type.

    Fields a schema does not name are ignored, and a NULL record stays NULL.
    With ``strict`` a record that is not JSON, has an unknown tag or a field of
    another type fails the query; without it such records are marked in
    ``malformed`` and their structs are NULL.
    """
    schemas = schemas or SCHEMAS
    text = F.col(value)
    tagged_df = df.withColumn("tag", F.get_json_object(text, f"$.{TAG}"))
    known = F.col("tag").isin(list(schemas))
    parsed = {t: F.from_json(text, _noting_faults(_text_keys(s)), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": FAULT}) for t, s in schemas.items()}
    wrong = reduce(lambda a, b: a | b, [(F.col("tag") == t) & p[FAULT].isNotNull() for t, p in parsed.items()])
    malformed = text.isNotNull() & (~F.coalesce(known, F.lit(False)) | F.coalesce(wrong, F.lit(False)))
    decoded = {
        t: F.when(
            (F.col("tag") == t) & parsed[t][FAULT].isNull(),
            F.struct(*[parsed[t][f.name].alias(f.name) for f in s.fields]).cast(s),
        )
        for t, s in schemas.items()
    }
    marked = tagged_df.withColumn("malformed", malformed)
    if strict:
        failure = F.raise_error(F.concat(F.lit("not a known message: "), text)).cast("boolean")
        marked = marked.withColumn("malformed", F.when(F.col("malformed"), failure).otherwise(F.lit(False)))
        return marked.withColumns(decoded).filter(~F.col("malformed")).drop("malformed")
    return marked.withColumns(decoded)


def _noting_faults(kind: T.StructType) -> T.StructType:
    return T.StructType([*kind.fields, T.StructField(FAULT, T.StringType())])


def json_field(text: Column | str, schema: str) -> Column:
    """Untagged JSON to a struct; NULL stays NULL."""
    return F.from_json(text, schema)
