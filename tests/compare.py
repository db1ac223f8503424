"""A query's rows beside those of its SQL."""

import datetime
import decimal
import os

import duckdb

BASE = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def both(spark, query, sql, base=BASE):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(base):
        p = f"{base}/{f}"
        con.sql(f"create view {f.split('.')[0]} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    df = query(spark, base)
    cols = sorted(df.columns)
    told = con.sql(sql)
    assert sorted(told.columns) == cols
    at = [told.columns.index(c) for c in cols]
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    return ours, sorted((tuple(plain(r[i]) for i in at) for r in told.fetchall()), key=repr)
