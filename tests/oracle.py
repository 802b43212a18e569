"""Runs a query and its SQL on the same tables and compares rows, whatever their order."""

import os

import duckdb

SF = "/root/testdata/sf0.001"


def connection(sf=SF):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in os.listdir(sf):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{t}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return "null" if v != v else repr(round(v, 6))
    return "null" if v is None else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in data)


def same(spark, query, sql, sf=SF):
    df = query(spark, sf)
    r = connection(sf).execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, r.fetchall())
