"""Compare a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.01")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def differences(spark, run, sql: str, data: Path = DATA) -> tuple[list, list, int]:
    con = duckdb.connect()
    for p in data.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = run(spark, str(data))
    want = con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    return list((a - b).items())[:5], list((b - a).items())[:5], sum(b.values())
