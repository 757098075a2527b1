"""Compares a query with its SQL on the same tables."""

import decimal
import os

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5) + 0.0
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def compare(spark, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = query(spark, DATA)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    a = sorted(repr(tuple(plain(r[c]) for c in order)) for r in got.collect())
    b = sorted(repr(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in order)) for r in cur.fetchall())
    assert a == b
