"""Registered queries against their DuckDB counterparts, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from matchloom.plans import registry

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the tables aren't there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    rows = sorted(repr([r[c] for c in columns]) for r in df.collect())
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    expected = duck.sql(registry.ORACLE_SQL[name])
    place = [expected.columns.index(c) for c in columns]
    assert sorted(expected.columns) == columns
    assert rows == sorted(repr([r[i] for i in place]) for r in expected.fetchall())
