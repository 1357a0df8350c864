"""Rows of a query and of its SQL in DuckDB, in a form that can be compared."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if isinstance(v, float):
            return None if v != v else round(v, 9)
        return None if v is None or v is pd.NaT or v is pd.NA else v if isinstance(v, (bool, int)) else str(v)

    cols = sorted(df.columns)
    return sorted((tuple(one(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)), key=repr)
