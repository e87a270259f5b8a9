"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return float(x) if isinstance(x, (float,)) else x


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def differences(spark, con, query, sql: str, folder: str) -> str:
    """An empty string where both give the same columns and rows."""
    df = query(spark, folder)
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    want_names, want = rel.columns, rel.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(set(got_names) ^ set(want_names))}"
    a, b = rows_of(got_names, got), rows_of(want_names, want)
    if len(a) != len(b):
        return f"{len(a)} rows, not {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    kinds = {n: (str(t1), str(t2)) for n, t1, t2 in ((n, dict(df.dtypes)[n], dict(zip(want_names, rel.types))[n]) for n in got_names)}
    odd = {n: k for n, k in kinds.items() if k[0] in ("bigint", "double", "string", "boolean") and {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}[k[0]] != k[1]}
    return (f"{len(bad)} of {len(a)} rows differ: {sorted(got_names)} {bad[:2]}" if bad else "") + (f" types {odd}" if odd else "")
