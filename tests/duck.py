"""Compares a query with its SQL in DuckDB."""

import glob
import os

import duckdb


def rows_of(rows):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


def compare(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    mine = rows_of(tuple(r) for r in df.select(*cols).collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    theirs = rows_of(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())
    assert mine == theirs
