"""Column expressions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Width of the published data set, size limits
# and coefficient of the adaptive buffer, gap history, default mean gap.
NUM_WORKERS = 4
NUM_FEATURES = 1024
MIN_BUFFER = 128
MAX_BUFFER = 1024
BUFFER_COEFFICIENT = 0.30000001192092896  # 0.3 as a 32-bit float, widened
GAP_HISTORY = 500
DEFAULT_GAP_MS = 1000.0
LOCAL_ITERATIONS = 2

BIAS = -1  # feature number of the intercept


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, cut to whole ms.

    Works on the calendar fields, so the session time zone does not matter.
    """
    ts = _col(ts)
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    second_ms = F.floor(F.date_part(F.lit("SECOND"), ts) * 1000).cast("long")
    return F.unix_date(ts.cast("date")).cast("long") * 86_400_000 + seconds.cast("long") * 1000 + second_ms


def sparse_map(values: Column | str) -> Column:
    """ARRAY of numbers to MAP<INT, number> without the zeros."""
    entries = F.transform(_col(values), lambda x, i: F.struct(i.alias("key"), x.alias("value")))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] != 0))


def sorted_entries(features: Column | str) -> Column:
    """MAP to ARRAY<STRUCT<key, value>> in key order."""
    return F.array_sort(F.map_entries(_col(features)))


def lookup(features: Column | str, key: Column | int) -> Column:
    """Value of ``key`` or NULL when the key is missing."""
    return F.try_element_at(_col(features), key if isinstance(key, Column) else F.lit(key))


def key_between(key: Column | str, start: int, end: int) -> Column:
    """Both ends included, the rule of a message's key range."""
    return _col(key).between(start, end)


def label_of(fields: Column | str) -> Column:
    """Last field of a row as INT."""
    return F.element_at(_col(fields), -1).cast("int")


def features_of(fields: Column | str) -> Column:
    """All fields but the last."""
    return F.slice(_col(fields), 1, F.size(_col(fields)) - 1)


def same_message(a: Column | str, b: Column | str) -> Column:
    """Clock, key range and values of two message structs are equal."""
    a, b = _col(a), _col(b)
    return (
        a["vectorClock"].eqNullSafe(b["vectorClock"])
        & a["keyRange"].eqNullSafe(b["keyRange"])
        & sorted_entries(a["values"]).eqNullSafe(sorted_entries(b["values"]))
    )


def target_size(
    mean_gap: Column | str,
    low: int = MIN_BUFFER,
    high: int = MAX_BUFFER,
    coefficient: float = BUFFER_COEFFICIENT,
) -> Column:
    """Wanted buffer size: ``coefficient`` times the events per minute, within [low, high].

    A mean gap of zero means an unbounded rate and gives ``high``.
    """
    if low < 1:
        raise ValueError("the buffer must hold at least one row")
    mean_gap = _col(mean_gap)
    per_minute = F.lit(float(coefficient)) * 60000 / F.when(mean_gap > 0, mean_gap)
    size = F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), F.floor(per_minute + 0.5).cast("double")))
    return F.when(mean_gap > 0, size).otherwise(F.lit(float(high))).cast("long")
