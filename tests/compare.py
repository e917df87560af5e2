"""Order-free comparison of a Spark result with DuckDB's, by column name."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if p.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return sorted((k, plain(v)) for k, v in x.items())
    return x


def rows(names, found) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


def differences(df, con, sql: str) -> str:
    """Empty when both sides hold the same rows and columns."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    there = rows(names, rel.fetchall())
    here = rows(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(here) != len(there):
        return f"{len(here)} rows and {len(there)}"
    odd = [(a, b) for a, b in zip(here, there, strict=True) if a != b]
    return f"{len(odd)} of {len(here)} rows differ: {odd[:2]}" if odd else ""
