"""Side-by-side run of registered queries and their SQL."""

from __future__ import annotations

import math
import time

import duckdb

from loomtext.plans.fixtures import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


TIMES: list[tuple[float, float]] = []
KINDS = {"bigint": "int", "int": "int", "INTEGER": "int", "BIGINT": "int", "string": "str", "VARCHAR": "str", "double": "float", "DOUBLE": "float", "boolean": "bool", "BOOLEAN": "bool"}


def compare(spark_df, con, sql):
    """None when equal, else what differs."""
    t0 = time.time()
    left = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    t1 = time.time()
    rel = con.sql(sql)
    right = rows_of(rel.columns, rel.fetchall())
    TIMES.append((t1 - t0, time.time() - t1))
    st = {f.name: f.dataType.simpleString() for f in spark_df.schema}
    dt = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    if left[0] != right[0]:
        return f"columns {left[0]} / {right[0]}"
    bad = {n: (st[n], dt[n]) for n in st if KINDS.get(st[n], st[n]) != KINDS.get(dt[n], dt[n]) or (st[n] == "int") != (dt[n] == "INTEGER")}
    if bad:
        return f"types {bad}"
    if left[1] != right[1]:
        diff = [(a, b) for a, b in zip(left[1], right[1]) if a != b][:2]
        return f"rows {len(left[1])} / {len(right[1])}: {str(diff)[:1500]}"
    return None if left[1] else "EMPTY"
