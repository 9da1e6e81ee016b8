"""Rows of Spark and DuckDB in one comparable form."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return repr(value)


def duck_rows(sf_dir: str, sql: str) -> tuple[list[str], list]:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    found = con.sql(sql)
    names = sorted(found.columns)
    at = [found.columns.index(n) for n in names]
    return names, sorted([plain(r[i]) for i in at] for r in found.fetchall())


def spark_rows(df) -> tuple[list[str], list]:
    names = sorted(df.columns)
    return names, sorted([plain(r[n]) for n in names] for r in df.collect())
