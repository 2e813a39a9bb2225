"""Rows of a query against rows of its SQL in DuckDB."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return float(f"{float(v):.9g}") if not isinstance(v, int) else v


def differences(df, sql: str, con) -> list[str]:
    """What differs, at most five rows of either side."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_names = sorted(names)
    if sorted(df.columns) != want_names:
        return [f"columns {sorted(df.columns)} and {want_names}"]
    at = [names.index(n) for n in want_names]
    want = Counter(tuple(_plain(r[i]) for i in at) for r in cur.fetchall())
    got = Counter(tuple(_plain(r[n]) for n in want_names) for r in df.collect())
    out = [f"only in Spark: {k} x {v}" for k, v in list((got - want).items())[:5]] + [f"only in SQL: {k} x {v}" for k, v in list((want - got).items())[:5]]
    return out if not out else [f"{sum(got.values())} and {sum(want.values())} rows", *out]
