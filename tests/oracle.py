"""Compares a query with its SQL on the same tables."""

from __future__ import annotations

import decimal
import os
from glob import glob

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob(f"{folder}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        db.sql(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{files}')")
    return db


def cell(v):
    if v is None or str(v) in ("<NA>", "nan", "NaT"):
        return None
    if isinstance(v, bool | str):
        return v
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 9)
    return int(v) if hasattr(v, "__int__") else v


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    return [*frame.columns], sorted((tuple(map(cell, r)) for r in frame.astype(object).itertuples(index=False)), key=str)


def assert_same(df, db: duckdb.DuckDBPyConnection, sql: str) -> None:
    assert canonical(df.toPandas()) == canonical(db.sql(sql).df())
