"""Every registered grid query against its SQL on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from gridloom import queries

DATA = os.environ.get("GRIDLOOM_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    frame = queries.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    if name not in queries.ORACLES:
        assert got
        return
    result = db.sql(queries.ORACLES[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
