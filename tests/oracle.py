"""Runs a query's SQL with DuckDB over the same tables and compares its rows with those of Spark."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os

import duckdb
from pyspark.sql import DataFrame

DATA = os.environ.get("PITSIGHT_TEST_DATA", "/root/testdata/sf0.001")


def connection(folder: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'; SET threads=4")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    """Values as they compare across both engines: floats to nine digits, times without a zone."""
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if value != value else float(f"{value:.9g}") + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def ordered(columns: list[str], rows: list[tuple]) -> list[tuple]:
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(row[i]) for i in at) for row in rows), key=repr)


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), ordered(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    return sorted(columns), ordered(columns, found.fetchall())
