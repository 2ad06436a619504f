"""Rows of a query and of its SQL, in one form that can be compared."""

from __future__ import annotations

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x if x is None or isinstance(x, (int, bool, str)) else str(x)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differ(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What is different, or None."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} and {names}"
    have, want = rows_of(df.columns, df.collect()), rows_of(names, found.fetchall())
    if have != want:
        first = next((p for p in zip(have, want, strict=False) if p[0] != p[1]), None)
        return f"{len(have)} and {len(want)} rows; {first}"
    return None
