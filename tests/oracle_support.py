"""Compares a query's rows with those of its SQL in DuckDB, columns by name, rows in any order."""

from __future__ import annotations

import math
from pathlib import Path


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, bool) or x is None or isinstance(x, (int, str)):
        return x
    return str(x)


def _sorted(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def differences(df, con, sql: str) -> str:
    """'' if both have the same columns and rows, else what differs first."""
    names, got = _sorted(df.columns, df.collect())
    cur = con.execute(sql)
    want_names, want = _sorted([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return f"columns {names} instead of {want_names}"
    if got == want:
        return ""
    a, b = set(got), set(want)
    return f"{len(got)} rows instead of {len(want)}; only here {sorted(a - b, key=repr)[:2]}; only there {sorted(b - a, key=repr)[:2]}"
