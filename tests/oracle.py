"""Comparing a query's rows with its SQL in DuckDB."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def cell(v):
    if v is None or pd.isna(v) is True:
        return "None"
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else f"{v:.9f}"
    return str(v)


def rows(df, columns):
    return sorted(tuple(map(cell, r)) for r in df[columns].itertuples(index=False))


def same(spark, query, sql, sf):
    found, expected = query(spark, sf).toPandas(), connect(sf).sql(sql).df()
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    assert rows(found, columns) == rows(expected, columns)
    return len(found)
