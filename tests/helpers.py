"""Comparison of a query's rows with those of its SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return f"{v:.6g}" if v == v else "nan"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    if isinstance(v, dict):
        return str({k: norm(x) for k, x in v.items()})
    return str(v)


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def assert_same(df, sql, sf_dir):
    rows = df.collect()
    con = duck(sf_dir)
    cur = con.execute(sql)
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == sorted(df.columns)
    cols = sorted(df.columns)
    want = sorted(tuple(norm(r[theirs.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(norm(r[c]) for c in cols) for r in rows) == want
