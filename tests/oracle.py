"""Comparing a query's rows with those of its DuckDB SQL."""

from __future__ import annotations

import math
import os
from collections import Counter
from pathlib import Path

import duckdb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'; SET threads = 4")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    """A value that compares alike whichever engine it comes from."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(name: str, found, sql: str, con: duckdb.DuckDBPyConnection) -> int:
    """Assert that both have the same columns and rows; the number of rows."""
    told = con.execute(sql)
    columns = [c[0] for c in told.description]
    assert sorted(columns) == sorted(found.columns), f"{name}: columns {columns} against {found.columns}"
    want, got = rows_of(columns, told.fetchall()), rows_of(found.columns, found.collect())
    missing, extra = want - got, got - want
    assert not missing and not extra, f"{name}: {sum(missing.values())} rows missing, such as {list(missing)[:3]}; {sum(extra.values())} too many, such as {list(extra)[:3]}"
    return sum(got.values())
