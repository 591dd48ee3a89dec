"""Each query against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest
from conftest import SF

from bayesloom.catalog import CATALOG


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or abs(a - b) <= 2e-4 * max(1, abs(a))
    return a == b


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if q.sql])
def test_query(spark, duck, name):
    q = CATALOG[name]
    ours = q.build(spark, SF)
    cols = sorted(ours.columns)
    got = sorted((tuple(r) for r in ours.select(*cols).collect()), key=repr)
    rel = duck.sql(q.sql)
    assert sorted(rel.columns) == cols
    want = sorted(rel.select(*(duckdb.ColumnExpression(c) for c in cols)).fetchall(), key=repr)
    assert len(got) == len(want) > 0
    assert all(same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))
