"""Spark's rows and the oracle's, as multisets."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def spark_rows(df) -> tuple[list[str], Counter]:
    cols = sorted(df.columns)
    return cols, Counter(repr(tuple(r[c] for c in cols)) for r in df.collect())


def duck_rows(con, sql: str) -> tuple[list[str], Counter]:
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    cols = sorted(names)
    return cols, Counter(repr(tuple(r[names.index(c)] for c in cols)) for r in got.fetchall())
