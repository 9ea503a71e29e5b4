"""Stored connectivity against scattered stencils, and its plan."""

import pytest

from gridloom.operators import connectivity, stencils
from gridloom.plans.checkpoint import setting
from gridloom.sources import cells as source
from gridloom.spec import COORDS, S6, S27, GridSpec


def field(spark):
    return source.sparse(spark, GridSpec(11, 9, 7), source.geometry("hollow_cube", (11, 9, 7), 1.0, 0.3)).withColumn("v", source.seeded(1, 9)).selectExpr("x - 4 AS x", "y", "z", "v")


def test_the_table_is_that_of_the_neighbours(spark):
    cells = field(spark)
    conn = connectivity.connect(cells, S27.without_center(), size=4)
    got = spark.table(conn.table).select(*COORDS, "slot", "nx", "ny", "nz")
    want = stencils.neighbour_keys(cells.select(*COORDS), S27.without_center()).selectExpr("x", "y", "z", "slot", "sx AS nx", "sy AS ny", "sz AS nz")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.table(connectivity.connect(cells.limit(0), S6).table).count() == 0


@pytest.mark.parametrize("size", [4, 16])
def test_three_in_a_row(spark, size):
    cells = field(spark)
    conn = connectivity.connect(cells, S6, 3, size)
    fold = lambda v, total, n: v - n * total
    got = connectivity.run(conn, cells, "v", [fold] * 3)
    want = cells
    for _ in range(3):
        want = stencils.laplace_count(want, "v").withColumnRenamed("value", "v")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*COORDS, "v").collect()))
    assert got.count() == cells.count()
    assert connectivity.run(conn, cells, "v", [fold]).exceptAll(stencils.laplace_count(cells, "v")).count() == 0
    with pytest.raises(ValueError, match="3 stencils"):
        connectivity.run(conn, cells, "v", [fold] * 4)
    table = connectivity.spread(conn, cells, "v")
    with setting(spark, connectivity.CO_PARTITION, "false"):
        plan = connectivity.chained(conn, table, cells, [fold] * 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 0 and plan.count("SortMergeJoin") + plan.count("HashJoin") >= 6


def test_no_table_goes_through_the_driver(spark):
    """Tables that look small in their files are merged where they lie, at the session's own limit for broadcasts too."""
    cells = field(spark)
    conn = connectivity.connect(cells, S6, 3)
    table = connectivity.spread(conn, cells, "v")
    with setting(spark, connectivity.CO_PARTITION, "false"):
        plan = connectivity.chained(conn, table, cells, [lambda v, total, n: v - n * total] * 3)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 6
