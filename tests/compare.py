"""A Spark result against DuckDB's on the same tables."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if path.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=lambda r: [(x is not None, str(type(x)), x) for x in r])


def check(df, sql: str, sf_dir: str) -> int:
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    con = duck(sf_dir)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows(names, cursor.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-5), (a, b)
    return len(got)
