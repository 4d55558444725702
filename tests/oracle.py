"""Rows of a query and of its SQL, as sorted lists that can be compared."""

import datetime

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        return str(v.replace(tzinfo=None))
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def both(spark, sf, query, sql):
    df = query(spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr([plain(x) for x in r]) for r in df.select(cols).collect())
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    r = c.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted(repr([plain(row[names.index(k)]) for k in cols]) for row in r.fetchall())
    return got, want
