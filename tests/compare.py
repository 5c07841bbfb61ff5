"""Running a query beside its SQL: same columns and the same rows, in any order, doubles to nine digits."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{source}'")
    return c


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 1e9 else str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def difference(df, connection, sql: str) -> str:
    """Empty if both sides agree."""
    expected = connection.sql(sql)
    columns = sorted(df.columns)
    if columns != sorted(expected.columns):
        return f"columns {columns} and {sorted(expected.columns)}"
    at = [expected.columns.index(c) for c in columns]
    mine = Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in expected.fetchall())
    if mine == theirs:
        return ""
    return f"{sum(mine.values())} and {sum(theirs.values())} rows; only here {list((mine - theirs).items())[:3]}; only there {list((theirs - mine).items())[:3]}"
