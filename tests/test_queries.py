"""Every registered query of the library against its SQL, over the smallest driver tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from termloom.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def shown(value: object) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(shown, value)) + "]"
    return str(value)


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return con


def test_every_query_has_sql() -> None:
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name: str) -> None:  # noqa: ANN001
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(shown(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())
