"""Rows of a query and of its SQL twin in DuckDB, as comparable text."""

from __future__ import annotations

import datetime as dt
import os

import duckdb

DIRECTORY = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(directory: str = DIRECTORY) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in sorted(os.listdir(directory)):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{directory}/{f}'")
    return c


def text(v) -> str:
    if v is None or v != v:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v)) if abs(v) < 2**53 else str(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted(tuple(text(v) for v in r) for r in df.select(*names).collect())


def rows_of_sql(c, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = c.execute(sql)
    columns = [x[0] for x in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(text(r[i]) for i in order) for r in cursor.fetchall())
