"""Compares a query's rows with what DuckDB makes of its SQL."""

from __future__ import annotations

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(columns: list[str], data) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if isinstance(x, float):
            return repr(round(x, 6))
        if hasattr(x, "normalize"):  # a decimal
            return repr(round(float(x), 6))
        return repr(x)

    return [columns[i] for i in order], sorted("|".join(plain(r[i]) for i in order) for r in data)


def differences(spark, sf_dir: str, query, sql: str, con=None) -> str:
    """What differs, or an empty string."""
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    found = (con or connection(sf_dir)).sql(sql)
    theirs = rows(found.columns, found.fetchall())
    if mine == theirs:
        return ""
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    a, b = set(mine[1]), set(theirs[1])
    return f"{len(mine[1])} and {len(theirs[1])} rows; only here {sorted(a - b)[:3]}; only there {sorted(b - a)[:3]}"
