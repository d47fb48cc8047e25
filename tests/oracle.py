"""Compare a DataFrame with a DuckDB result, column by column and row by row."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb
from pyspark.sql import DataFrame, Row

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    """A value in a form that both engines share."""
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return repr(round(v, 5) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, Row):
        v = v.asDict()
    if isinstance(v, dict):
        return str(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return repr(float(v)) if isinstance(v, int) else repr(v)


def same(df: DataFrame, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    want = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    number = lambda r: tuple(plain(float(x) if isinstance(x, int) and not isinstance(x, bool) else x) or "" for x in r)
    got = sorted(number(r[c] for c in names) for r in df.collect())
    assert got == sorted(number(r[i] for i in at) for r in want.fetchall())
