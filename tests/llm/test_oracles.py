"""Queries of this subpackage that SQL can express, against their oracles on the smallest tables."""

import os

import duckdb
import pytest

from bomspark.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query(spark, key):
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    cursor = con.execute(ORACLES[key])
    columns = [d[0] for d in cursor.description]
    rows = QUERIES[key](spark, SF)
    assert sorted(columns) == sorted(rows.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in rows.collect())
    assert got == sorted(map(repr, cursor.fetchall())) and got
