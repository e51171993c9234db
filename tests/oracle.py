"""Comparison of a Spark query with its SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else glob.glob(p)[0]}')")
    return con


def plain(v: object) -> object:
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, bytearray):
        return bytes(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows_of(columns: list[str], rows: list) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs, or None."""
    rel = con.sql(sql)
    names, want = rows_of(rel.columns, rel.fetchall())
    mine, got = rows_of(df.columns, df.collect())
    if mine != names:
        return f"columns {mine}, SQL has {names}"
    if len(got) != len(want):
        return f"{len(got)} rows, SQL has {len(want)}"
    return next((f"row {g}, SQL has {w}" for g, w in zip(got, want) if g != w), None)
