"""Compares a query's rows with its DuckDB SQL: same columns, same bag of rows."""

from __future__ import annotations

import datetime
import decimal
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def same(df, sql: str, sf_dir: str) -> None:
    con = connect(sf_dir)
    con.execute(sql)
    names = [d[0] for d in con.description]
    want = con.fetchall()
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    a = Counter(tuple(plain(v) for v in r) for r in df.collect())
    b = Counter(tuple(plain(r[i]) for i in order) for r in want)
    assert sum(a.values()) == sum(b.values()), f"{sum(a.values())} rows and {sum(b.values())}"
    assert a == b, f"only Spark: {list((a - b).items())[:3]}; only SQL: {list((b - a).items())[:3]}"
