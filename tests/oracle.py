"""Comparison of a query with its SQL on the same tables."""

import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.sql(f"create view {file.split('.')[0]} as select * from '{sf_dir}/{file}'")
    return con


def _text(x) -> str:
    if x is None or x is pd.NA or (isinstance(x, float) and x != x):
        return "null"
    if isinstance(x, float):
        return f"{x:.6g}" if x != int(x) else str(int(x))
    return str(bytes(x) if isinstance(x, bytearray) else x)


def rows(frame: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(_text, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


def same(spark, sf_dir, query, sql) -> None:
    got = query(spark, sf_dir).toPandas().astype(object)
    want = connect(sf_dir).sql(sql).df().astype(object)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
