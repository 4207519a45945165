"""Comparison of a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    def text(x: object) -> str:
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return "null"
        return f"{x:.6f}" if isinstance(x, float) else str(x)

    out = df[sorted(df.columns)].map(text)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def same(spark, folder: str, query, sql: str) -> None:
    ours = query(spark, folder).toPandas()
    theirs = connection(folder).sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    pd.testing.assert_frame_equal(canonical(ours), canonical(theirs))
