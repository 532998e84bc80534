"""Side-by-side comparison with DuckDB over the same tables."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _cell(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, Decimal):
        return str(x)
    return str(x) if x is not None else None


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in data), key=repr)


def compare(spark, sf_dir, run, sql):
    df = run(spark, sf_dir)
    got = df.collect()
    rel = connect(sf_dir).execute(sql)
    names = [c[0] for c in rel.description]
    want = rel.fetchall()
    assert sorted(df.columns) == sorted(names)
    a, b = rows(df.columns, got), rows(names, want)
    assert len(a) == len(b), (len(a), len(b))
    for x, y in zip(a, b):
        assert x == y, (x, y)
