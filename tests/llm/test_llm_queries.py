"""Every query runs over the whole tables; those with SQL give the rows that DuckDB gives for it."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tests.test_queries import cell, same
from tidewater.llm import queries


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, data, name):
    assert name in entry.queries()
    df = queries.QUERIES[name](spark, data)
    names = sorted(df.columns)
    rows = df.select(names).collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows or name == "p9_edited"
        return
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in Path(data).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    assert sorted(con.sql(sql).columns) == names
    want = con.sql(f"select {', '.join(names)} from ({sql})").fetchall()
    assert same(Counter(tuple(map(cell, r)) for r in rows), Counter(tuple(map(cell, r)) for r in want))
