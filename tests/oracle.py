"""Compares a registered query with its SQL counterpart, run by DuckDB on the same files."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        if name in TABLES:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, name, query, sql, sf_dir) -> str | None:
    """None when equal, otherwise what differs."""
    got = query(spark, sf_dir)
    got_names, got_rows = got.columns, [tuple(row) for row in got.collect()]
    found = con.execute(sql)
    want_names = [entry[0] for entry in found.description]
    want_rows = found.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"{name}: columns {sorted(got_names)} != {sorted(want_names)}"
    mine, theirs = rows_of(got_names, got_rows), rows_of(want_names, want_rows)
    if mine != theirs:
        return (f"{name}: {len(got_rows)} rows vs {len(want_rows)}; "
                f"only here {list((mine - theirs).items())[:4]}; "
                f"only in SQL {list((theirs - mine).items())[:4]} ({sorted(got_names)})")
    types = [type(v).__name__ for v in (got_rows[0] if got_rows else ())]
    for i, column in enumerate(got_names):
        j = want_names.index(column)
        kinds = {type(r[i]).__name__ for r in got_rows if r[i] is not None}
        other = {type(r[j]).__name__ for r in want_rows if r[j] is not None}
        if kinds != other:
            return f"{name}: {column} is {kinds} here, {other} in SQL {types}"
    return None
