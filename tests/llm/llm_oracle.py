"""Comparison of a query with its SQL on the same tables."""

import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def connect(folder=DATA):
    c = duckdb.connect()
    for p in folder.iterdir():
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


def cell(x):
    if x is None:
        return ""
    if isinstance(x, float):
        return "" if math.isnan(x) else f"{x:.9g}"
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def same(c, sql, df):
    q = c.execute(sql)
    names = [x[0] for x in q.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(names, q.fetchall()) == rows(df.columns, [tuple(r) for r in df.collect()])
