"""Comparison of a Spark result with DuckDB's on the same tables."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(v):
    v = v.tolist() if hasattr(v, "tolist") else v
    if isinstance(v, dict):
        return tuple(canonical(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(canonical(x) for x in v)
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return repr(round(float(v), 5) + 0.0)
    return str(v) if not isinstance(v, datetime.datetime) else v.isoformat()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def from_duckdb(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    return rows_of([d[0] for d in got.description], got.fetchall())


def from_spark(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])
