"""Balance, culling and meshes against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.lbm import multires as flow
from gridloom.lbm.lattice import C19, W19
from gridloom.operators import multires
from gridloom.plans.checkpoint import setting
from gridloom.sources import cells as source
from gridloom.sources import mesh
from gridloom.spec import S27, GridSpec


def plain_balance(cells, dims, depth):
    have, todo = set(cells), list(cells)
    while todo:
        level, *at = todo.pop()
        if level == depth - 1:
            continue
        for o in S27:
            n = [a + b * (1 << level) for a, b in zip(at, o, strict=True)]
            if any(not 0 <= a < d for a, d in zip(n, dims, strict=True)):
                continue
            w = 2 << level
            up = [a // w * w for a in n]
            family = [(level + 1, *up)] if level + 1 == depth - 1 else [(level + 1, *[a // (2 * w) * 2 * w + b * w for a, b in zip(up, c, strict=True)]) for c in np.ndindex(2, 2, 2)]
            for c in family:
                if all(a < d for a, d in zip(c[1:], dims, strict=True)) and c not in have:
                    have.add(c)
                    todo.append(c)
    return have


def test_only_the_cells_added_last_ask(spark):
    grid, depth = GridSpec(32, 32, 16), 4
    start = spark.createDataFrame([(0, 3, 5, 7), (0, 20, 21, 2), (3, 0, 0, 0)], "level int, x int, y int, z int")
    trace = []
    got = {tuple(r) for r in multires.balance(start, grid, depth, trace=trace).collect()}
    assert got == plain_balance({tuple(r) for r in start.collect()}, (32, 32, 16), depth)
    assert sum(trace) == len(got) and len(trace) > 2
    assert multires.balance(start.limit(0), grid, depth).count() == 0
    assert {tuple(r) for r in multires.balance(start.unionAll(start), grid, depth).collect()} == got


def test_balanced_levels_that_are_too_large_for_a_broadcast(spark):
    """What all rounds added is joined with its parents by a merge too."""
    grid, marks = GridSpec(32, 32, 16), [F.col("x") < 3, F.lit(False), F.col("y") < 9, F.lit(True)]
    got = {tuple(r) for r in multires.build(spark, grid, marks).collect()}
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        assert {tuple(r) for r in multires.build(spark, grid, marks).collect()} == got
        assert multires.cull(multires.build(spark, grid, marks), grid).count() < len(got)
    cells = {c[:4] for c in got}
    assert cells == plain_balance(cells, (32, 32, 16), 4)


def test_culled_cells_have_no_open_neighbour(spark):
    grid = GridSpec(16, 16, 8)
    cells = multires.build(spark, grid, [(F.col("x") < 12) & (F.col("y") > 3), F.lit(True)])
    rows = {(r.level, r.x, r.y, r.z): r.refined for r in cells.collect()}
    keep = set()
    for (level, *at), refined in rows.items():
        near = [(level, *[a + b * (1 << level) for a, b in zip(at, o, strict=True)]) for o in S27.without_center()]
        inside = [n for n in near if all(0 <= a < d for a, d in zip(n[1:], (16, 16, 8), strict=True))]
        if not refined or not all(rows.get(n) for n in inside):
            keep.add((level, *at))
    culled = {(r.level, r.x, r.y, r.z) for r in multires.cull(cells, grid).collect()}
    assert culled == keep and len(culled) < len(rows)


def test_levels_from_frames(spark):
    grid = GridSpec(8, 8, 8)
    places = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (6, 2, 3)], "x int, y int, z int")
    by_frame = multires.build(spark, grid, [places, F.lit(True)])
    by_column = multires.build(spark, grid, [((F.col("x") == 1) & (F.col("y") == 1) & (F.col("z") == 1)) | ((F.col("x") == 6) & (F.col("y") == 2) & (F.col("z") == 3)), F.lit(True)])
    assert by_frame.exceptAll(by_column).count() == by_column.exceptAll(by_frame).count() == 0


def test_a_sub_step_takes_two_shuffles(spark):
    cells = multires.build(spark, GridSpec(12, 8, 8), [F.col("x") < 6, F.lit(True)])
    state = flow.at_rest(cells, (12, 8, 8), 2, C19, W19, 0.05)
    for part in (flow.store_fine(state, 0, C19), flow.stream(state, 0, C19)):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def sphere(n=12, r=4.3, at=(8.2, 7.7, 8.4)):
    """Rings of quadrilaterals as triangles, outward oriented."""
    points = [(0, 0, r)] + [(r * np.sin(t) * np.cos(p), r * np.sin(t) * np.sin(p), r * np.cos(t)) for t in np.pi * np.arange(1, n) / n for p in 2 * np.pi * np.arange(2 * n) / (2 * n)] + [(0, 0, -r)]
    ring = lambda i, j: 1 + (i - 1) * 2 * n + j % (2 * n)
    faces = [(0, ring(1, j), ring(1, j + 1)) for j in range(2 * n)] + [(len(points) - 1, ring(n - 1, j + 1), ring(n - 1, j)) for j in range(2 * n)]
    for i in range(1, n - 1):
        for j in range(2 * n):
            faces += [(ring(i, j), ring(i + 1, j), ring(i + 1, j + 1)), (ring(i, j), ring(i + 1, j + 1), ring(i, j + 1))]
    return np.array(points) + at, np.array(faces)


def cube(low, high):
    corners = np.array([[a, b, c] for a in (low, high) for b in (low, high) for c in (low, high)], float)
    quads = ((0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3))
    return corners, np.array([t for a, b, c, d in quads for t in ((a, b, c), (a, c, d))])


@pytest.mark.parametrize("limit", [4096, 5])
@pytest.mark.parametrize("shape", ["sphere", "cube", "nested", "on the lattice"])
def test_meshes_equal_the_loop(spark, monkeypatch, shape, limit):
    monkeypatch.setattr(mesh, "CLUSTERS", limit)
    if shape == "sphere":
        points, faces = sphere()
    elif shape == "cube":
        points, faces = cube(2.6, 11.3)
    elif shape == "nested":
        (p, f), (q, g) = cube(1.5, 14.5), cube(4.5, 9.5)
        points, faces = np.concatenate([p, q]), np.concatenate([f, g[:, ::-1] + len(p)])
    else:
        points, faces = cube(3.5, 11.5)
        points[:, 1:] = np.round(points[:, 1:] + 0.1)
    cells = source.dense(spark, GridSpec(16, 16, 16)).filter("(x + 3 * y + 7 * z) % 5 = 0")
    got = {(r.x, r.y, r.z): (r.inside, r.distance) for r in mesh.with_mesh(cells, points, faces).collect()}
    at = np.array(sorted(got), float)
    winding, distance = mesh.winding(at, points[faces]), mesh.distance(at, points[faces])
    assert len(got) == cells.count()
    for place, w, d in zip(map(tuple, at.astype(int).tolist()), winding, distance, strict=True):
        assert abs(got[place][1] - d) < 1e-9
        if d > 1e-9:
            assert got[place][0] == (w > 0.5), place


def test_no_triangles(spark):
    cells = source.dense(spark, GridSpec(3, 3, 3))
    rows = mesh.with_mesh(cells, np.zeros((0, 3)), np.zeros((0, 3), int)).collect()
    assert len(rows) == 27 and not any(r.inside for r in rows) and all(r.distance == float("inf") for r in rows)
    line = mesh.with_mesh(cells, np.array([[0, 0, 0], [2, 0, 0], [1, 0, 0]], float), np.array([[0, 1, 2]])).collect()
    assert all(r.distance == pytest.approx(np.hypot(r.y, r.z)) and not r.inside for r in line)


def test_blocks_around_a_small_mesh_stay_spread(spark):
    """They aren't dealt by groups of triangles, and far cells are held against few of them; distances stay those of all triangles."""
    points, faces = mesh.net(4)
    at = mesh.fit(points, (10.3, 10.3, 10.3), 12.0)
    rng = np.random.default_rng(3)
    for low in (0.0, 40.0, 30000.0):
        cells = rng.integers(-9, 30, (60, 3)) + np.array([0.0, 0.0, low])
        assert np.allclose(mesh.nearest(cells, at[faces]), mesh.distance(cells, at[faces]), rtol=1e-12)
    # Triangles without area are taken as lines or points.
    thin = np.array([[[0, 0, 0], [4, 0, 0], [8, 0, 0]], [[1, 1, 1], [1, 1, 1], [1, 1, 1]]], float)
    assert np.allclose(mesh.nearest(cells, thin), mesh.distance(cells, thin))
    far = spark.range(8 * 8 * 400).selectExpr("int(id % 8) AS x", "int(id DIV 8 % 8) AS y", "int(id DIV 64) AS z")
    made = mesh.distances(far, mesh.triangles_of(spark, at, faces))
    assert "BroadcastHashJoin" in made._jdf.queryExecution().executedPlan().toString()
    rows = made.collect()
    want = mesh.distance(np.array([r[:3] for r in rows], float), at[faces])
    assert len(rows) == far.count() and np.allclose([r.distance for r in rows], want, rtol=1e-12)
