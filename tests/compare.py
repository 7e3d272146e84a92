"""Compare a Spark result with a DuckDB result as bags of rows."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    answer = con.execute(sql)
    names = [c[0] for c in answer.description]
    expected = answer.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    rows = df.collect()
    if len(rows) != len(expected):
        return f"{len(rows)} rows against {len(expected)}"
    ours, theirs = bag(df.columns, rows), bag(names, expected)
    if ours == theirs:
        return None
    return f"only ours {list((ours - theirs).items())[:3]}; only SQL {list((theirs - ours).items())[:3]}"
