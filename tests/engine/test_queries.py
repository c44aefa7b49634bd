"""Every registered engine query against its oracle on the smallest tables."""

import os

import duckdb
import pytest

from bomspark.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query(spark, oracle, key):
    rows = QUERIES[key](spark, SF)
    cursor = oracle.execute(ORACLES[key])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(rows.columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in rows.collect()) == sorted(map(repr, cursor.fetchall()))


def test_diff_laws(spark):
    from bomspark.operators.diff import diff
    from bomspark.queries import Snapshots

    s = Snapshots(spark, SF)
    assert diff(s.after, s.after).rows.where("status <> 'same'").isEmpty()
    there, back = diff(s.before, s.after), diff(s.after, s.before)
    assert {r.id for r in there.added.collect()} == {r.id for r in back.removed.collect()}


def test_list_by_name_is_whole_and_in_order(spark, oracle):
    rows = [tuple(r) for r in QUERIES["sort_by_name_all"](spark, SF).collect()]
    assert rows == oracle.execute(ORACLES["sort_by_name_all"]).fetchall() == sorted(rows) and len(rows) > 50


def test_whole_findings_cover_every_row(spark):
    from bomspark.queries import Snapshots

    s = Snapshots(spark, SF)
    total = s.after.count() - s.before.count()
    assert {"fnd_dominant_path_all", "msg_dominant_type_all", "msg_ecosystems_all"} <= set(QUERIES)
    text = QUERIES["msg_surface_all"](spark, SF).first().message
    assert (f"{total:+d} packages" in text) == (total != 0)
