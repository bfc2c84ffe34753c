"""Row-set comparison of a registered query with its SQL in DuckDB."""
from __future__ import annotations

import datetime
import math

import duckdb

from rostrum.plans.inputs import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


def compare(df, con, sql: str):
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = rows_of(cur.fetchall(), want_names)
    got = rows_of(df.collect(), df.columns)
    if sorted(want_names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(want_names)}"
    if got == want:
        return None
    a, b = set(got), set(want)
    return f"{len(got)} vs {len(want)} rows; only spark {sorted(a - b, key=repr)[:3]}; only sql {sorted(b - a, key=repr)[:3]}"
