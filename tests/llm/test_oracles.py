"""Operators against their SQL counterparts, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from matchloom.llm import queries

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the tables aren't there")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    duck = duckdb.connect()
    for path in SF.glob("*.parquet"):
        duck.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    expected = duck.sql(queries.ORACLE_SQL[name])
    place = [expected.columns.index(c) for c in columns]
    assert sorted(expected.columns) == columns
    rows = sorted(repr([r[c] for c in columns]) for r in df.collect())
    assert rows == sorted(repr([r[i] for i in place]) for r in expected.fetchall())
