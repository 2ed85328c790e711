"""Run SQL in DuckDB over the tables and compare it with a Spark result.

Compared are the columns' names and types, the number of rows, and the values whatever
the order of rows and columns. Nested values are compared element by element, and NaN
equals NaN. Types are compared by ``duckdb_type``: an int is no BIGINT and a DOUBLE no
DECIMAL. The whole result comes to the test, so it is for small tables.
"""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb
from pyspark.sql import types as T

from larkspan.sources import TABLES

SIMPLE = {
    T.BooleanType: "BOOLEAN",
    T.ByteType: "TINYINT",
    T.ShortType: "SMALLINT",
    T.IntegerType: "INTEGER",
    T.LongType: "BIGINT",
    T.FloatType: "FLOAT",
    T.DoubleType: "DOUBLE",
    T.StringType: "VARCHAR",
    T.BinaryType: "BLOB",
    T.DateType: "DATE",
    T.TimestampNTZType: "TIMESTAMP",
    T.TimestampType: "TIMESTAMP WITH TIME ZONE",
}


def duckdb_type(kind: T.DataType) -> str:
    """The DuckDB type that a Spark type has to meet."""
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    if isinstance(kind, T.ArrayType):
        return duckdb_type(kind.elementType) + "[]"
    if isinstance(kind, T.MapType):
        return f"MAP({duckdb_type(kind.keyType)}, {duckdb_type(kind.valueType)})"
    if isinstance(kind, T.StructType):
        return f"STRUCT({', '.join(f'{f.name} {duckdb_type(f.dataType)}' for f in kind)})"
    return SIMPLE[type(kind)]


def frozen(value):
    """A value that can be counted and compared: nested ones as tuples, NaN as a mark."""
    if isinstance(value, float) and math.isnan(value):
        return "NaN", None
    if isinstance(value, dict):
        return tuple(sorted((k, frozen(v)) for k, v in value.items()))
    if isinstance(value, tuple) and hasattr(value, "asDict"):
        return frozen(value.asDict())
    if isinstance(value, (list, tuple)):
        return tuple(map(frozen, value))
    return bytes(value) if isinstance(value, bytearray) else value


def _sorted_columns(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(frozen(row[i]) for i in order) for row in rows)


def _oracle(sf_dir, sql):
    with duckdb.connect() as con:
        for name in TABLES:
            path = f"{sf_dir}/{name}.parquet"
            files = glob.glob(f"{path}/*.parquet") if os.path.isdir(path) else [path]
            if files and os.path.exists(files[0]):
                con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet({files})")
        cursor = con.execute(sql)
        described = cursor.description
        return [c[0] for c in described], [str(c[1]) for c in described], cursor.fetchall()


def oracle_rows(sf_dir, sql):
    names, _, rows = _oracle(sf_dir, sql)
    return names, rows


def assert_same(df, sf_dir, sql):
    """Same names, types, count and values, whatever the order of rows and columns."""
    names, types, rows = _oracle(sf_dir, sql)
    assert sorted(df.columns) == sorted(names)
    assert {f.name: duckdb_type(f.dataType) for f in df.schema} == dict(zip(names, types, strict=True))
    _, want = _sorted_columns(names, rows)
    _, got = _sorted_columns(df.columns, [tuple(row) for row in df.collect()])
    assert sum(got.values()) == sum(want.values())
    assert got == want
    return sum(want.values())
