"""Runs a query and its SQL side by side."""

import decimal
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) or 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    return v


def connect(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def both(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=str)
    run = connect(sf_dir).execute(sql)
    names = [d[0] for d in run.description]
    assert sorted(names) == columns
    order = sorted(range(len(names)), key=names.__getitem__)
    return ours, sorted((tuple(norm(r[i]) for i in order) for r in run.fetchall()), key=str)
