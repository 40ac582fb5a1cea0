"""Every registered query against its SQL on the smallest tables, and its schema on both sides."""

import math
import os

import duckdb
import pytest

from docloom.plans import registry

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = sorted(repr(tuple(map(_plain, r))) for r in df.collect())
    if name not in registry.ORACLES:
        assert rows
        return
    rel = duck.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == sorted(df.columns)
    types = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == types
    order = [rel.columns.index(c) for c in df.columns]
    assert rows == sorted(repr(tuple(_plain(r[i]) for i in order)) for r in rel.fetchall())
