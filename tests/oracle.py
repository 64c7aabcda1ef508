"""Compare registered queries with their SQL in DuckDB, regardless of row order."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, (bool, str)) or v is None:
        return v
    if isinstance(v, (int, decimal.Decimal)):
        return float(v) if isinstance(v, decimal.Decimal) else v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def kinds(rows):
    """Value kinds per column, so that a 1 that should be 1.0 is noticed."""
    out = []
    for col in zip(*rows):
        out.append(sorted({type(v).__name__ for v in col if v is not None}))
    return out


TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def differences(df, con, sql):
    types = {c: TYPES.get(t, t) for c, t in df.dtypes}
    wanted = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if types != wanted:
        return f"types {types} != {wanted}"
    got_names, got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_names, want = table([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    if kinds(got) != kinds(want):
        return f"kinds {kinds(got)} != {kinds(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"{g} != {w}"
    return None
