"""Text queries that SQL can express, against it on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from gridloom.llm import queries

DATA = os.environ.get("GRIDLOOM_DATA", "/root/testdata/sf0.001")


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    db = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    frame = queries.queries()[name](spark, DATA)
    result = db.sql(queries.oracle_sql()[name])
    columns = sorted(frame.columns)
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)


def test_every_operator_has_one_query():
    assert [int(k[2:].split("_")[0]) for k in queries.queries()] == sorted(int(k[2:].split("_")[0]) for k in queries.queries())
