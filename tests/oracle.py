"""Comparison of a Spark result with DuckDB's, as multisets of rows."""

from __future__ import annotations

import os

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_sql(sf_dir: str, sql: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con.execute(sql).df()


def same(got, wanted) -> None:
    assert sorted(got.columns) == sorted(wanted.columns)
    columns = sorted(got.columns)

    def cell(x):
        if isinstance(x, float):
            return f"{x:.9g}"
        return str(tuple(x)) if isinstance(x, list | np.ndarray) else str(x)

    def rows(df):
        return sorted(map(tuple, df[columns].map(cell).to_numpy().tolist()))

    assert rows(got) == rows(wanted)
