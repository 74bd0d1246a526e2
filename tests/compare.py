"""Compare a Spark result with the SQL oracle, order-insensitive."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _clean(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return v


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_clean(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def oracle_rows(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return rows_of(names, cur.fetchall())


def differences(got, want, limit: int = 3) -> list[str]:
    out = []
    if got[0] != want[0]:
        return [f"columns {got[0]} != {want[0]}"]
    if len(got[1]) != len(want[1]):
        out.append(f"rows {len(got[1])} != {len(want[1])}")
    if got[1] == want[1]:
        return out
    a, b = set(map(repr, got[1])), set(map(repr, want[1]))
    out += [f"only spark: {x[:400]}" for x in sorted(a - b)[:limit]]
    out += [f"only oracle: {x[:400]}" for x in sorted(b - a)[:limit]]
    return out or ["same sets, other counts"]
