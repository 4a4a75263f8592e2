"""Rows of a query and of its SQL as multisets of texts."""

import math
from collections import Counter

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(shown, v)) + "]"
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    return str(v)


def multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(shown(r[i]) for i in order) for r in rows)


def check(spark, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = query(spark, SF)
    got = con.sql(sql)
    assert sorted(df.columns) == sorted(got.columns)
    assert multiset(df.columns, df.collect()) == multiset(got.columns, got.fetchall())
