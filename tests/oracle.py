"""Runs a registered query and its SQL over the same tables and compares the rows."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, Decimal):
        return ("num", float(v))
    if isinstance(v, (int, float)):
        return ("num", "nan" if isinstance(v, float) and math.isnan(v) else float(v))
    if isinstance(v, dt.datetime):
        return ("ts", v.isoformat())
    if isinstance(v, (list, tuple)):
        return ("list", tuple(_cell(x) for x in v))
    return v


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(cells, key=repr)


def differences(df, con, sql: str, limit: int = 3) -> list[str]:
    """Empty when both sides agree; exact except that integers and floats compare by value."""
    left_names, left = _sorted(df.columns, [tuple(x) for x in df.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    right_names, right = _sorted(names, cur.fetchall())
    if left_names != right_names:
        return [f"columns {left_names} != {right_names}"]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    sql_types = {c[0]: str(c[1]) for c in cur.description}
    out = []
    for n in left_names:
        s, d = types[n], sql_types[n].upper()
        ok = {"double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "date": "DATE",
              "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}.get(s)
        if ok != d:
            out.append(f"type of {n}: {s} / {d}")
    if len(left) != len(right):
        out.append(f"rows {len(left)} != {len(right)}")
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        out.append(f"{len(bad)} rows differ")
        for a, b in bad[:limit]:
            out.append(str([(n, x, y) for n, x, y in zip(left_names, a, b) if x != y][:6]))
    return out
