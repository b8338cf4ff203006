"""Compares a query's rows with those of its SQL in DuckDB, regardless of order."""

from __future__ import annotations

import glob
import os


def connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(sf_dir + "/*.parquet"):
        source = p if os.path.isfile(p) else p + "/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{source}'")
    return con


def _plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v


def rows(names: list[str], values) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([_plain(r[i]) for i in order]) for r in values)


def differs(df, con, sql: str) -> str:
    """'' if both have the same columns and rows, else what is different."""
    got = df.toArrow()
    cursor = con.execute(sql)
    want = cursor.fetchall()
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(got.column_names):
        return f"columns {sorted(got.column_names)} and {sorted(names)}"
    a, b = rows(got.column_names, (tuple(r.values()) for r in got.to_pylist())), rows(names, want)
    if a != b:
        return f"{len(a)} and {len(b)} rows; only in Spark {[x for x in a if x not in set(b)][:3]}; only in SQL {[x for x in b if x not in set(a)][:3]}"
    return ""
