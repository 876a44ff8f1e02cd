"""Run a query and its SQL on the same Parquet tables and compare."""

import glob
import math
import os

import duckdb


def connect(base):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{base}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{src}'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def same(spark, base, query, sql):
    df = query(spark, base)
    got = [tuple(r) for r in df.collect()]
    rel = connect(base).sql(sql)
    want = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns), (df.columns, rel.columns)
    a, b = rows(df.columns, got), rows(rel.columns, want)
    assert len(a) == len(b), (len(a), len(b), a[:2], b[:2])
    for x, y in zip(a, b):
        assert x == y, (x, y)
    return len(a)
