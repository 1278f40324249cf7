"""Runs a query in Spark and its SQL in DuckDB and compares the rows, whatever their order."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        if os.path.exists(at):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at + '/*.parquet' if os.path.isdir(at) else at}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


def rows(names: list[str], data: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, name: str, f, sql: str, sf_dir: str) -> tuple[int, list]:
    """Row count and the first differences."""
    df = f(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = connection(sf_dir).execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    if got == want:
        return len(got[1]), []
    assert got[0] == want[0], (name, got[0], want[0])
    a, b = set(got[1]), set(want[1])
    return len(got[1]), [len(got[1]), len(want[1]), sorted(a - b, key=repr)[:3], sorted(b - a, key=repr)[:3]]


def sf(name: str) -> str:
    found = glob.glob(f"/root/testdata/{name}")
    return found[0] if found else ""
