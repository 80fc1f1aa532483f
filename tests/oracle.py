"""Comparison of a query with its SQL in DuckDB: rows as sorted tuples by column name."""

from __future__ import annotations

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(value, v))
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(value(r[n]) for n in names) for r in df.collect()), key=repr)


def sql_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    r = con.execute(sql)
    cols = [c[0] for c in r.description]
    names = sorted(cols)
    at = [cols.index(n) for n in names]
    return names, sorted((tuple(value(row[i]) for i in at) for row in r.fetchall()), key=repr)
