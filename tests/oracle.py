"""Side-by-side check of a Spark frame against SQL on the same parquet tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    text = df.apply(lambda col: col.map(_text))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def _text(value) -> str:
    if value is None or value is pd.NA or (isinstance(value, float) and value != value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        return repr(float(value) + 0.0)
    return str(value)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty when both hold the same rows in any order."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows"
    a, b = canonical(got), canonical(want)
    off = (a != b).any(axis=1)
    if not off.any():
        return ""
    return f"{off.sum()} of {len(a)} rows differ\n{a[off].head(4)}\n{b[off].head(4)}"
