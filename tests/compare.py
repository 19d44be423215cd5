"""Run a named query and its SQL twin and report how they differ."""

from __future__ import annotations

import glob
import os
from decimal import Decimal

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def differences(spark_df, con, sql: str) -> str | None:
    names, got = spark_df.columns, [tuple(r) for r in spark_df.collect()]
    cursor = con.execute(sql)
    sql_names, want = [d[0] for d in cursor.description], cursor.fetchall()
    if sorted(names) != sorted(sql_names):
        return f"columns {sorted(names)} != {sorted(sql_names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    order = sorted(names)
    a = sorted((_row(r, names, order) for r in got), key=repr)
    b = sorted((_row(r, sql_names, order) for r in want), key=repr)
    for x, y in zip(a, b):
        for name, u, v in zip(order, x, y):
            if type(u) is not type(v) or u != v:
                return f"column {name}: {u!r} != {v!r} in {x} and {y}"
    return None


def _row(row, names, order):
    values = dict(zip(names, row))
    return tuple(_value(values[n]) for n in order)


def _value(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6) + 0.0
    return v
