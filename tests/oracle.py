"""Run a query and its SQL over the same tables and compare the rows."""

from __future__ import annotations

import decimal
from pathlib import Path

import duckdb

SF = Path("/root/testdata/sf0.001")


def plain(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float | decimal.Decimal):
        return repr(round(float(value), 6) + 0.0)
    return str(value)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


def sql_rows(sql: str, folder: Path = SF):
    db = duckdb.connect()
    for f in folder.glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
