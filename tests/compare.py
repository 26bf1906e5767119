"""Runs a query and its SQL on one folder of tables and tells where they differ."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def tables(con, sf_dir):
    for p in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(p)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p}/*.parquet'" if os.path.isdir(p) else f"CREATE VIEW {name} AS SELECT * FROM '{p}'")


def difference(spark, query, sql, sf_dir):
    """None, or a text that tells the difference."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    con = duckdb.connect()
    tables(con, sf_dir)
    rel = con.execute(sql)
    theirs_names = [d[0] for d in rel.description]
    if sorted(theirs_names) != names:
        return f"columns {names} and {sorted(theirs_names)}"
    at = [theirs_names.index(n) for n in names]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    if ours == theirs:
        return None
    a, b = set(map(repr, ours)), set(map(repr, theirs))
    return f"{len(ours)} and {len(theirs)} rows; {names}; only ours {sorted(a - b)[:3]}; only SQL's {sorted(b - a)[:3]}"[:1500]
