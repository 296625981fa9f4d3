"""Compare a query with its SQL in DuckDB, regardless of row and column order."""

import math
from collections import Counter

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or str(v) in ("True", "False"):
        return str(v)
    try:
        return f"{float(v):.7g}" if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(frame.columns), Counter(tuple(map(_cell, r)) for r in frame.itertuples(index=False, name=None))


def check(spark, query, sql, folder=DATA):
    import os

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{f}')")
    ours, theirs = rows(query(spark, folder).toPandas()), rows(con.sql(sql).df())
    assert ours[0] == theirs[0]
    assert sum(ours[1].values()) == sum(theirs[1].values())
    assert not (ours[1] - theirs[1]), list((ours[1] - theirs[1]).items())[:3]
