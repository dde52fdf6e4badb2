"""Every query with SQL gives the rows that DuckDB gives for it; the others run and have rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidewater.plans import extras, features, gold, problems, serving, streams

CORE = [name for m in (problems, gold, serving, features, extras, streams) for name in m.QUERIES]


def cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6) if abs(v) < 1e9 else float(v)
    return str(v)


def same(a: Counter, b: Counter) -> bool:
    """Equal as multisets; what is left over may differ by the last rounded digit."""
    x, y = sorted((a - b).elements(), key=repr), sorted((b - a).elements(), key=repr)
    near = lambda p, q: p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-9, abs_tol=2e-6))
    return len(x) == len(y) and all(all(map(near, p, q)) for p, q in zip(x, y, strict=True))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in Path(data).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    names = sorted(df.columns)
    rows = df.select(names).collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    rel = duck.sql(sql)
    assert sorted(rel.columns) == names
    want = duck.sql(f"select {', '.join(names)} from ({sql})").fetchall()
    assert same(Counter(tuple(map(cell, r)) for r in rows), Counter(tuple(map(cell, r)) for r in want))


def test_entry(spark, data):
    assert entry.entry(spark).limit(1).collect()
