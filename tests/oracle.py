"""Compare a query with its SQL in DuckDB: the same columns, rows and values."""

import glob
import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else v
        return tuple(v) if isinstance(v, list) else v

    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple(str(x) for x in r))


def same(frame, con, sql):
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(frame.columns) == sorted(names)
    a, b = rows(frame.columns, frame.collect()), rows(names, got.fetchall())
    assert len(a) == len(b)
    assert [x for x in zip(a, b, strict=True) if x[0] != x[1]] == []
