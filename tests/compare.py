"""Compare a query with its SQL on the same files."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    return names, done.fetchall()


def plain(v):
    return v + 0.0 if isinstance(v, float) else v


def check(spark, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    names, want = sql_rows(sf_dir, sql)
    assert sorted(df.columns) == sorted(names), (name, df.columns, names)
    order = sorted(names)
    key = lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in order) for r in want), key=key)
    assert len(got) == len(want), (name, len(got), len(want))
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, (name, len(bad), len(got), bad[:3])
