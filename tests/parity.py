"""Comparison of a Spark result with DuckDB's, regardless of row order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, str):
        return v
    return round(float(v), 5) + 0.0


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(plain(v) for v in r)) for r in df.astype(object).itertuples(index=False, name=None))
