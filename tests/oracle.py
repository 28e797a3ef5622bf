"""Comparison of a query with its oracle SQL in DuckDB."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    whole = frame.columns[[pd.api.types.is_float_dtype(frame[c]) and bool((frame[c].dropna() % 1 == 0).all()) for c in frame]]
    frame = frame.astype(dict.fromkeys(whole, "Int64"))  # whole numbers with nulls come as floats from one side
    cell = lambda v: "null" if v is None or v is pd.NA or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return list(frame.columns), sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False, name=None))


def expected(sql, sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c.execute(sql).df()
