"""Registered queries without SQL read whole tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from matchloom.plans import registry

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the tables aren't there")


def test_name_address_parse(spark):
    rows = registry.QUERIES["name_address_parse"](spark, str(SF)).collect()
    ids = {f"{t[0]}-{r[0]}" for t, key in (("customer", "c_custkey"), ("supplier", "s_suppkey")) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(key).collect()}
    assert len(rows) == len(ids) + 6 and ids < {r["entity_id"] for r in rows}
    named = {r["entity_id"]: r for r in rows}
    assert all(named[i]["house_num"] == i[2:] for i in ids)
