"""Runs a query and its oracle side by side, as multisets of rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}{'/**' if os.path.isdir(p) else ''}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    if isinstance(v, dict):
        return str([_plain(x) for x in v.values()])
    if isinstance(v, int):
        return str(v)
    return str(v)


def compare(spark, con, sf_dir: str, query, sql: str) -> tuple[int, list, list]:
    """(rows of the query, rows only in the query, rows only in the oracle)."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == names, (sorted(rel.columns), names)
    ours = sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())
    order = [rel.columns.index(c) for c in names]
    theirs = sorted(tuple(_plain(r[i]) for i in order) for r in rel.fetchall())
    from collections import Counter

    a, b = Counter(ours), Counter(theirs)
    return len(ours), list((a - b).elements())[:5], list((b - a).elements())[:5]
