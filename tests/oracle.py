"""Runs a query on Spark and its SQL on DuckDB and compares the rows as multisets."""

import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        name, path = f.split(".")[0], f"{sf_dir}/{f}"
        con.execute(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if hasattr(x, "item"):
        x = x.item()
    return round(x, 9) if isinstance(x, float) else x


def rows(names, tuples):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(str(tuple(plain(t[i]) for i in order)) for t in tuples)


def check(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, cursor.fetchall())
    return len(got)
