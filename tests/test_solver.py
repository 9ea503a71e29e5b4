"""Conjugate gradients against a dense solve; how they end, and what an iteration costs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import packed
from gridloom.solver import cg
from gridloom.sources import cells as source
from gridloom.spec import COORDS, S6, GridSpec


def problem(spark):
    """A sparse grid with some fixed cells."""
    k = F.col("x") + 7 * F.col("y") + 56 * F.col("z")
    cells = source.dense(spark, GridSpec(7, 8, 9)).filter(k % 5 != 2)
    fixed = k % 4 == 0
    return cells.select(*COORDS, F.when(fixed, k % 3).otherwise(0).cast("double").alias("u"), (k % 7 - 3).cast("double").alias("b"), (~fixed).cast("int").alias("boundary"))


def dense(rows, h):
    at = {(r.x, r.y, r.z): i for i, r in enumerate(rows)}
    a, b = np.eye(len(rows)), np.array([r.b if r.boundary else r.u for r in rows])
    for i, r in enumerate(rows):
        if r.boundary:
            near = [at[n] for n in ((r.x + o[0], r.y + o[1], r.z + o[2]) for o in S6) if n in at]
            a[i, i] = len(near) / h**2
            a[i, near] -= 1 / h**2
            if not near:
                a[i, i] = 1
    return dict(zip(at, np.linalg.solve(a, b), strict=True))


@pytest.mark.parametrize("h", [1.0, 0.5])
def test_solution_is_that_of_the_dense_system(spark, h):
    field = problem(spark)
    solved, end = cg.solve(field, h=h, parameters=cg.Parameters(relative=1e-11), size=4)
    want = dense(field.collect(), h)
    got = {(r.x, r.y, r.z): r.u for r in solved.collect()}
    assert end.status == "converged" and end.residual < 1e-11 * end.start and end.iterations < 60
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_breakdown_is_an_error(spark):
    """Free cells alone, with a source: no solution. What has no curvature isn't solved."""
    rows = spark.createDataFrame([(i, 0, 0, 0.0, 1.0, 1) for i in range(3)], "x int, y int, z int, u double, b double, boundary int")
    end = cg.solve(rows)[1]
    assert end.status == "error" and end.residual == end.start == pytest.approx(3**0.5)
    nan = rows.withColumn("b", F.lit(float("nan")))
    assert cg.solve(nan)[1].status == "error"
    solved, end = cg.solve(rows.withColumn("b", F.lit(0.0)))
    assert end.status == "converged" and end.iterations == 0 and solved.count() == 3
    assert cg.solve(rows.limit(0))[1].status == "converged"


def test_other_ends(spark):
    field = problem(spark)
    assert cg.solve(field, parameters=cg.Parameters(max_iterations=2, relative=1e-12))[1] == cg.Result("limit", 2, pytest.approx(cg.solve(field, parameters=cg.Parameters(max_iterations=2, relative=1e-12))[1].residual), pytest.approx(cg.solve(field, parameters=cg.Parameters(max_iterations=1))[1].start))
    assert cg.solve(field, parameters=cg.Parameters(relative=1e-12, divergence=1e-9))[1].status == "error"
    assert cg.solve(field, parameters=cg.Parameters(absolute=1e9))[1].iterations == 1


def test_an_iteration_is_one_write(spark):
    field, context, seen = problem(spark), spark.sparkContext, []
    for n in (3, 6):
        context.setJobGroup(f"cg{n}", "solver")
        cg.solve(field, parameters=cg.Parameters(max_iterations=n, relative=1e-14))
        seen.append(len(context.statusTracker().getJobIdsForGroup(f"cg{n}")))
    context.setJobGroup("", "")
    # The faces' side of the shuffle is a job of its own under adaptive execution; the sums add none.
    assert seen[1] - seen[0] == 2 * 3


def test_tables_have_as_many_parts_as_their_cells_need(spark):
    """Not as many as the session's partitions: an iteration of few cells would be tasks without rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        assert packed.buckets_for(spark, 100) == 12 and packed.buckets_for(spark, 13 * packed.CELLS) == 13 and packed.buckets_for(spark, 10**9) == 24
        table, end = cg.solve_packed(problem(spark), size=4, buckets=3)
        assert end.status == "converged" and table.buckets == 3 and len(table.frame().inputFiles()) <= 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
