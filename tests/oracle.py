"""Run a registered query on Spark and its SQL on DuckDB, and compare the rows as the driver does."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    out = []
    for row in df.itertuples(index=False, name=None):
        cells = []
        for v in row:
            if v is None or v is pd.NA or (isinstance(v, float) and v != v):
                cells.append("~")
            elif isinstance(v, (float,)) or type(v).__name__.startswith("float"):
                cells.append(repr(float(v) + 0.0))
            elif isinstance(v, bool) or type(v).__name__ == "bool":
                cells.append(str(bool(v)))
            else:
                cells.append(str(v))
        out.append(tuple(cells))
    return sorted(out)


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both sides hold the same columns and rows, else what differs."""
    a, b = spark_df.toPandas(), con.execute(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} and {sorted(b.columns)}"
    x, y = canonical(a), canonical(b)
    if len(x) != len(y):
        return f"{len(x)} and {len(y)} rows"
    bad = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
    if not bad:
        return ""
    close = sum(all(m == n or _near(m, n) for m, n in zip(p, q, strict=True)) for p, q in bad)
    return f"{len(bad)} of {len(x)} rows differ ({close} only in a last place), such as {bad[0]}"


def _near(m: str, n: str) -> bool:
    try:
        return abs(float(m) - float(n)) < 1e-3 * max(1.0, abs(float(m)))
    except ValueError:
        return False
