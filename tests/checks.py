"""Comparison of a query with its SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd


def _text(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return "None"
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, np.integer):
        return str(int(v))
    return str(list(v)) if isinstance(v, list | np.ndarray) else str(v)


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(_text)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def against_sql(frame, sql: str, folder: str) -> None:
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    pd.testing.assert_frame_equal(normal(frame.toPandas()), normal(con.execute(sql).fetchdf()), check_dtype=False)
