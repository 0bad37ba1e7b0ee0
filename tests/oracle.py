"""Compares a registered query with its SQL run by DuckDB on the same tables."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def duck(sf: str = "sf0.001"):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(DATA, sf).iterdir():
        con.execute(f"create view {p.stem} as select * from read_parquet('{p if p.is_file() else f'{p}/*.parquet'}')")
    return con


def difference(spark, name: str, sf: str = "sf0.001") -> tuple[Counter, Counter, int]:
    import __spark_entry__ as e

    df = e.queries()[name](spark, f"{DATA}/{sf}")
    cols = sorted(df.columns)
    ours = Counter(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    rel = duck(sf).sql(e.oracle_sql()[name])
    assert sorted(rel.columns) == cols, (sorted(rel.columns), cols)
    at = [rel.columns.index(c) for c in cols]
    theirs = Counter(tuple(_plain(r[i]) for i in at) for r in rel.fetchall())
    return ours - theirs, theirs - ours, sum(ours.values())
