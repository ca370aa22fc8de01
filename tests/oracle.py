"""Side-by-side comparison of a query and its SQL."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, int) and not isinstance(v, bool):
        return v
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, sf_dir, run, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows(names, cur.fetchall())
    df = run(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    if mine != theirs:
        a, b = [x for x in mine if x not in set(theirs)], [x for x in theirs if x not in set(mine)]
        raise AssertionError(f"{len(mine)} rows, SQL {len(theirs)}; only here {a[:3]}; only in SQL {b[:3]}")
    return len(mine)
