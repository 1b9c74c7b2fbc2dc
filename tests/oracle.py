"""Runs registered queries beside their SQL in DuckDB and compares rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if type(x).__name__ == "Decimal":
        return round(float(x), 6)
    return x


def compare(spark, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    rel = connect(sf_dir).execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names), (name, df.columns, names)
    order = sorted(names)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in rel.fetchall()), key=repr)
    assert len(mine) == len(theirs), (name, len(mine), len(theirs))
    for a, b in zip(mine, theirs, strict=True):
        if a != b:
            for x, y in zip(a, b, strict=True):
                same = x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-6))
                assert same, (name, a, b)
