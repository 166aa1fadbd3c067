"""A query's rows against those of its SQL: same columns, same kinds of values, same rows in any order."""

import datetime as dt
import decimal
import glob
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def kind(x):
    if isinstance(x, bool):
        return "bool"
    if isinstance(x, int):
        return "int"
    if isinstance(x, float):
        return "float"
    if isinstance(x, decimal.Decimal):
        return "decimal"
    if isinstance(x, dt.datetime):
        return "time"
    return type(x).__name__


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, dt.datetime):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path):
            path = sorted(glob.glob(f"{path}/*.parquet"))
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({path!r})")
    return con


def compare(spark, con, sf_dir, run, sql):
    """An empty string if both agree, else what differs."""
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    mine = [tuple(r[c] for c in names) for r in df.collect()]
    if not mine:
        return "no rows"
    if empty := [c for i, c in enumerate(names) if all(r[i] is None for r in mine)]:
        return f"columns of nulls only: {empty}"
    found = con.execute(sql)
    theirs_names = [d[0] for d in found.description]
    if sorted(theirs_names) != names:
        return f"columns {names} and {sorted(theirs_names)}"
    at = [theirs_names.index(c) for c in names]
    theirs = [tuple(r[i] for i in at) for r in found.fetchall()]
    for i, c in enumerate(names):
        a, b = ({kind(r[i]) for r in rows if r[i] is not None} for rows in (mine, theirs))
        if a and b and a != b:
            return f"{c}: {a} and {b}"
    a, b = (Counter(tuple(map(plain, r)) for r in rows) for rows in (mine, theirs))
    if a == b:
        return ""
    more, less = a - b, b - a
    key = lambda r: tuple(map(str, r))
    return f"{len(mine)} and {len(theirs)} rows, {sum(more.values())} differ {names}: {sorted(more, key=key)[:2]} and {sorted(less, key=key)[:2]}"
