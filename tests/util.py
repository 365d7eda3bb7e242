"""Comparison of a query with its SQL."""

import datetime
import math
import os


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(norm(x)) for x in v) + "]"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v) if isinstance(v, float) else str(v)


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return con


def same(df, con, sql):
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=str)
    assert got == want
