"""Compare a Spark result with its DuckDB twin: names, types, rows and values, whatever the rows' order."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb

KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "binary": "BLOB",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        at = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{at}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return bytes(v) if isinstance(v, (bytearray, memoryview)) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> list[str]:
    """What differs; empty where nothing does."""
    cur = con.execute(sql)
    names, kinds = [d[0] for d in cur.description], [str(d[1]) for d in cur.description]
    want, got = cur.fetchall(), [tuple(r) for r in df.collect()]
    found = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} for {sorted(names)}"]
    theirs = dict(zip(names, kinds, strict=True))
    for n, k in df.dtypes:
        if KINDS.get(k, k) != theirs[n] and k in KINDS:
            found.append(f"type of {n}: {k} for {theirs[n]}")
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        found.append(f"{len(a)} rows for {len(b)}")
    bad = [(x, y) for x, y in zip(a, b, strict=False) if x != y]
    if bad:
        found.append(f"{len(bad)} rows differ in {sorted(names)}, first {bad[0][0]!r:.600} for {bad[0][1]!r:.600}")
    return found
