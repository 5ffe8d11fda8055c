"""Query results against DuckDB on the same Parquet tables."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    return con


def plain(value):
    """A form in which the two engines' values compare equal."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, bytearray):
        return bytes(value)
    return value


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    return sorted(columns), rows_of(columns, found.fetchall())


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty where both return the same columns and rows."""
    (columns, rows), (other, expected) = spark_rows(df), sql_rows(con, sql)
    if columns != other:
        return f"columns {columns} and {other}"
    if rows != expected:
        extra, missing = set(map(repr, rows)) - set(map(repr, expected)), set(map(repr, expected)) - set(map(repr, rows))
        return f"{len(rows)} and {len(expected)} rows; only here: {sorted(extra)[:3]}; only there: {sorted(missing)[:3]}"
    return ""
