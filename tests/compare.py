"""Compares a query's rows with those of its SQL, as sorted tuples over columns in the order of their names."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return round(float(v), 5)
    return v


def rows(names, data) -> Counter:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in data)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def differences(df, con, sql: str):
    """(rows of df missing in SQL's, rows of SQL missing in df's); column names have to agree."""
    rel = con.sql(sql)
    names = rel.columns
    if sorted(names) != sorted(df.columns):
        return ["columns"], [sorted(names), sorted(df.columns)]
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, rel.fetchall())
    return list((a - b).items()), list((b - a).items())
