"""Compare a registered query with its SQL in DuckDB over the same Parquet tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, dt.datetime):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(i) for i in x)
    return x


def rows(columns: list[str], data) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(got: tuple, want: tuple, most: int = 3) -> list:
    if got[0] != want[0]:
        return [("columns", got[0], want[0])]
    if len(got[1]) != len(want[1]):
        a, b = set(got[1]), set(want[1])
        return [("rows", len(got[1]), len(want[1])), *sorted(a - b, key=repr)[:most], "|", *sorted(b - a, key=repr)[:most]]
    return [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b][:most]


def check(spark, name: str, query, sql: str, sf_dir: str) -> list:
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    rel = connect(sf_dir).execute(sql)
    want = rows([c[0] for c in rel.description], rel.fetchall())
    return differences(got, want)
