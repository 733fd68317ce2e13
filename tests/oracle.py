"""Compare a query with its SQL in DuckDB, as sorted rows with columns in order of name."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"create view {path.stem} as select * from read_parquet('{source}')")
    return con


def _plain(x):
    if x is None:
        return None
    if isinstance(x, bool):
        return int(x)
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, (list, tuple)):
        return tuple(_plain(v) for v in x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, int):
        return float(f"{x:.15g}") if abs(x) < 2**53 else x
    return str(x)


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str, show: int = 3) -> list[str]:
    """What differs between a Spark result and the SQL's, in words; empty if nothing does."""
    ours = df.collect()
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    theirs = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    a, b = rows(df.columns, [tuple(r) for r in ours]), rows(names, theirs)
    out = [] if len(a) == len(b) else [f"{len(a)} rows against {len(b)}"]
    if a != b:
        left, right = [x for x in a if x not in set(b)][:show], [x for x in b if x not in set(a)][:show]
        out += [f"only ours: {x}" for x in left] + [f"only SQL: {x}" for x in right]
    return out
