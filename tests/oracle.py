"""Runs a query and its SQL side by side on the same tables."""

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def connection(sf_dir=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, (float, Decimal)) and not isinstance(x, bool):
        return None if isinstance(x, float) and math.isnan(x) else round(float(x), 5) + 0.0
    if isinstance(x, int) and not isinstance(x, bool):
        return float(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


def compare(spark, con, query, sql, sf_dir=SF):
    df = query(spark, sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    got, expected = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, cur.fetchall())
    assert len(got) == len(expected), (len(got), len(expected), got[:3], expected[:3])
    bad = [(a, b) for a, b in zip(got, expected) if a != b]
    assert not bad, bad[:3]
    return len(got)
