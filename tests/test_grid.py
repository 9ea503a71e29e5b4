"""Grid operators against NumPy and against each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.lbm import uniform
from gridloom.lbm.lattice import C19, C27, OPPOSITE_19, OPPOSITE_27, W19, W27, Cavity
from gridloom.operators import maps, multires, partitions, reductions, staggered, stencils, subsets
from gridloom.plans.pipeline import REDUCE, STENCIL, Operator, Pipeline
from gridloom.solver import cg
from gridloom.sources import cells as source
from gridloom.sources import sinks
from gridloom.spec import COORDS, S6, S7, S19, S27, GridSpec, Stencil

GRIDS = [(10, 17, 13), (1, 1, 100), (17, 1, 77)]


def linear(spark, dims, parts=3, offset=1):
    grid = GridSpec(*dims)
    return grid, source.dense(spark, grid, parts).withColumn("v", source.linear(grid, 0, offset))


def as_array(spark, grid, field, column="value"):
    return source.to_dense(spark, grid, field, [column])[0]


def shifted(a, offset):
    """a at the cell plus offset, and where that is inside."""
    dx, dy, dz = offset
    value, ok = np.zeros_like(a), np.zeros(a.shape, bool)
    nz, ny, nx = a.shape
    z, y, x = np.meshgrid(range(nz), range(ny), range(nx), indexing="ij")
    inside = (0 <= x + dx) & (x + dx < nx) & (0 <= y + dy) & (y + dy < ny) & (0 <= z + dz) & (z + dz < nz)
    value[inside] = a[(z + dz)[inside], (y + dy)[inside], (x + dx)[inside]]
    ok[inside] = True
    return value, ok


@pytest.mark.parametrize("dims", GRIDS)
def test_laplacians(spark, dims):
    grid, field = linear(spark, dims)
    a = np.arange(grid.size, dtype=float).reshape(dims[::-1]) + 1
    total = sum(shifted(a, o)[0] for o in S6)
    count = sum(shifted(a, o)[1].astype(float) for o in S6)
    assert (as_array(spark, grid, stencils.laplace_count(field, "v")) == a - count * total).all()
    assert (as_array(spark, grid, stencils.laplace_standard(field, "v")) == 6 * a - total).all()
    assert (as_array(spark, grid, stencils.laplace_neighbours(field, "v")) == -6 * total).all()
    fixed = field.withColumn("bd", (F.col("v") % 3 > 0).cast("int"))
    want = np.where(a % 3 == 0, a, (count * a - total) / 0.25)
    assert np.allclose(as_array(spark, grid, stencils.laplace_matvec(fixed, "v", "bd", 0.5)), want)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_results_do_not_depend_on_partitions(spark, parts):
    grid, field = linear(spark, (6, 5, 7), parts)
    first = stencils.laplace_count(linear(spark, (6, 5, 7), 2)[1], "v")
    assert source.max_diff(first, stencils.laplace_count(field, "v"), "value").first().max_diff == 0
    assert reductions.dot(field, "v", "v").first().dot == sum((k + 1) ** 2 for k in range(grid.size))


def test_dense_equals_sparse_with_all_cells(spark):
    grid, field = linear(spark, (5, 4, 6))
    all_ = source.sparse(spark, grid, F.lit(True)).withColumn("v", source.linear(grid, 0, 1))
    assert stencils.gradient(field, "v").exceptAll(stencils.gradient(all_, "v")).count() == 0


@pytest.mark.parametrize("size", [1, 4, 16])
def test_blocks_equal_columns(spark, size):
    from gridloom.operators import halo

    cells = source.sparse(spark, GridSpec(9, 7, 11), source.geometry("hollow_cube", (9, 7, 11), 1.0, 0.3)).withColumn("v", source.seeded(1, 99))
    assert halo.laplace_count(cells, "v", size).exceptAll(stencils.laplace_count(cells, "v")).count() == 0
    assert halo.laplace_count(cells, "v", size).count() == cells.count()
    with pytest.raises(ValueError, match="radius"):
        halo.deal(cells, 4, 5)


def test_gradient_and_life(spark):
    grid = GridSpec(6, 6, 3)
    field = source.dense(spark, grid).withColumn("v", (F.col("x") * F.col("x") + 3 * F.col("y")).cast("double"))
    got = {(r.x, r.y, r.z): (r.gx, r.gy, r.gz) for r in stencils.gradient(field, "v", 1.0).collect()}
    assert got[2, 2, 1] == (4.0, 3.0, 0.0) and got[0, 2, 1] == (0.0, 0.0, 0.0)
    blinker = source.dense(spark, GridSpec(5, 5, 1)).withColumn("v", ((F.col("x") == 2) & F.col("y").between(1, 3)).cast("int"))
    alive = {(r.x, r.y) for r in stencils.life(blinker, "v").collect() if r.value}
    assert alive == {(1, 2), (2, 2), (3, 2)}


def test_halo_check_finds_no_mismatch(spark):
    cells = source.sparse(spark, GridSpec(9, 9, 9), source.geometry("hollow_sphere", (9, 9, 9), 0.9, 0.4))
    rows = stencils.halo_check(cells, S27.without_center()).collect()
    assert rows and all(r.mismatches == 0 and r.valid == r.matches for r in rows)
    assert {r.flag for r in stencils.neighbour_flags(cells, (1, 0, 0)).collect()} == {0, 1}


def test_stencil_algebra():
    assert S6.offsets == ((0, 0, -1), (0, 0, 1), (0, -1, 0), (0, 1, 0), (-1, 0, 0), (1, 0, 0))
    assert (len(S7), len(S19), len(S27)) == (7, 19, 27) and S19.radius() == 1 and Stencil(((0, 3, -4),)).radius() == 4
    assert Stencil.union(S6, S7).offsets == (*S6.offsets, (0, 0, 0)) and S7.add((0, 0, 0)) is S7 and S7.find((1, 0, 0)) == 6 and S7.find((2, 0, 0)) == -1
    with pytest.raises(ValueError, match="at once"):
        stencils.check_stencil_reads(["a"], ["a", "b"])


def test_one_shuffle_per_stencil(spark):
    _, field = linear(spark, (6, 5, 7))
    plan = stencils.laplace_count(field, "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_subsets_and_outside_points(spark):
    grid, field = linear(spark, (4, 4, 4))
    inside = spark.createDataFrame([(1, 1, 1), (2, 3, 0)], "x int, y int, z int")
    assert source.subset(field, inside).count() == 2
    with pytest.raises(Exception, match="outside the outer grid"):
        source.subset(field, inside.union(spark.createDataFrame([(9, 9, 9)], "x int, y int, z int"))).collect()
    pushed = subsets.push(inside.withColumn("v", F.lit(0).cast("long")), field, "v")
    assert pushed.filter("v = 0").count() == 2 and pushed.count() == grid.size


def test_dense_round_trip_and_makers(spark):
    grid = GridSpec(4, 3, 2)
    cells = source.sparse(spark, grid, F.col("x") != 1)
    values = np.random.default_rng(0).random((2, 2, 3, 4))
    back = source.to_dense(spark, grid, source.from_dense(spark, cells, values), ["c0", "c1"], -1.0)
    assert np.array_equal(back[:, :, :, 0], values[:, :, :, 0]) and (back[:, :, :, 1] == -1).all()
    made = cells.select(*COORDS, source.masked(1, 2).alias("m"), source.seeded(10, 20, 3).alias("s"))
    assert all(r.m == r.z + 100 * r.y + 10**4 * r.x + 10**6 + 2 * 10**7 and 10 <= r.s <= 20 for r in made.collect())
    with pytest.raises(ValueError, match="smaller"):
        source.from_dense(spark, cells, np.zeros((1, 1, 1, 1)))
    with pytest.raises(ValueError, match="component"):
        source.new_field(cells, 1.0, 0)


def test_slabs(spark):
    cells = source.dense(spark, GridSpec(2, 2, 11))
    bounds = partitions.slab_bounds(11, 3)
    assert bounds == [(0, 4), (4, 8), (8, 11)]
    assert cells.filter(partitions.dense_slab(11, 3) != partitions.slab_of(bounds)).count() == 0
    with pytest.raises(ValueError, match="planes"):
        partitions.dense_slab(2, 3)
    with pytest.raises(ValueError, match="thinner"):
        partitions.data_view(bounds, 2)
    for shape in ("sphere", "lower_left", "hollow_cube"):
        ball = source.sparse(spark, GridSpec(16, 16, 24), source.geometry(shape, (16, 16, 24), 0.9, 0.5))
        cut = partitions.sparse_bounds(ball, 2)
        assert all(b - a >= 3 for a, b in cut) and ball.filter(partitions.slab_of(cut).isNull()).count() == 0
    assert partitions.properties(cells, [(0, 11)]).filter("data_view <> 'INTERNAL'").count() == 0


def test_views_add_up(spark):
    _, field = linear(spark, (3, 3, 12))
    viewed = field.withColumn("data_view", partitions.data_view(partitions.slab_bounds(12, 3)))
    total = {r.data_view: r.total for r in reductions.by_view(viewed, F.col("v")).collect()}
    assert total["STANDARD"] == total["INTERNAL"] + total["BOUNDARY"]


def test_reduction_checks(spark):
    _, a = linear(spark, (3, 3, 3))
    _, b = linear(spark, (3, 3, 4))
    reductions.check_same_grid(a, a)
    with pytest.raises(ValueError, match="different cells"):
        reductions.check_same_grid(a, b)
    assert reductions.dot(a.limit(0), "v", "v").first().dot == 0


def test_staggered(spark):
    voxels = source.dense(spark, GridSpec(3, 3, 3)).withColumn("v", F.lit(8.0))
    means = {(r.x, r.y, r.z): r.value for r in staggered.node_means(voxels, "v").collect()}
    assert len(means) == 64 and means[1, 1, 1] == 8.0 and means[0, 0, 0] == 1.0
    nodes = staggered.nodes_of(voxels).withColumn("n", (F.col("x") + 10 * F.col("y")).cast("double"))
    assert {(r.x, r.y, r.z): r.value for r in staggered.node_of_voxel(voxels, nodes, (1, -1, 1), "n").collect()}[1, 2, 0] == 22.0


def test_multires(spark):
    grid = GridSpec(24, 24, 24)
    x = F.col("x")
    cells = multires.build(spark, grid, [x < 8, (x >= 8) & (x < 16), x >= 16])
    rows = {(r.level, r.x, r.y, r.z): r.refined for r in cells.collect()}
    assert sum(1 for (lv, *_), refined in rows.items() if not refined and lv == 0) == 8 * 24 * 24
    covered = sum(8**lv for (lv, *_), refined in rows.items() if not refined)
    assert covered == 24**3
    for (lv, a, b, c), refined in rows.items():
        assert refined == ((lv - 1, a, b, c) in rows)
    jump = multires.build(spark, GridSpec(32, 8, 8), [x < 2, F.lit(False), F.lit(True)], balanced=True)
    held = {(r.level, r.x, r.y, r.z) for r in jump.collect()}
    for lv, a, b, c in held:
        w = 1 << lv
        for dx, dy, dz in S27:
            q = (a + dx * w, b + dy * w, c + dz * w)
            if lv < 2 and all(0 <= v < n for v, n in zip(q, (32, 8, 8), strict=True)):
                assert (lv + 1, *[v // (2 * w) * (2 * w) for v in q]) in held
    assert multires.omega(1.7, 2, 3) == pytest.approx(1.7) and [multires.uncle_offset(i, q) for i, q in ((0, -1), (1, -1), (0, 0), (0, 1), (1, 1))] == [-1, 0, 0, 0, 1]


def test_pipeline(spark, tmp_path):
    _, field = linear(spark, (4, 4, 4))
    steps = Pipeline("flow").sequence(
        Operator("scale", ("x",), ("y",), lambda e: {"y": maps.apply(e["x"], maps.scale(2, "v", "v"))}),
        Pipeline("inner").sequence(Operator("laplace", ("y",), ("z",), lambda e: {"z": stencils.laplace_count(e["y"], "v").withColumnRenamed("value", "v")}, STENCIL)),
        Operator("dot", ("z",), ("s",), lambda e: {"s": reductions.dot(e["z"], "v", "v")}, REDUCE),
    )
    env = steps.run({"x": field}, times=2, cut_every=1)
    direct = stencils.laplace_count(field.withColumn("v", F.col("v") * 2), "v")
    assert env["s"].first().dot == direct.agg(F.sum(F.col("value") * F.col("value"))).first()[0]
    assert steps.dependencies() == [("scale", "laplace", "RAW"), ("laplace", "dot", "RAW")]
    assert '"scale" -> "laplace"' in steps.depend("scale", "dot").to_dot()
    with pytest.raises(ValueError, match="at once"):
        Operator("bad", ("a",), ("a",), lambda e: e, STENCIL)
    with pytest.raises(KeyError):
        steps.run({})


def test_conjugate_gradients(spark):
    z = F.col("z")
    u = F.when(z == 0, -20.0).when(z == 7, 20.0).otherwise(0.0)
    grid = source.dense(spark, GridSpec(3, 3, 8)).select(*COORDS, u.alias("u"), F.lit(0.0).alias("b"), z.between(1, 6).cast("int").alias("boundary"))
    solved, end = cg.solve(grid, parameters=cg.Parameters(relative=1e-10))
    assert end.status == "converged" and all(abs(r.u - (-20 + 40 * r.z / 7)) < 1e-6 for r in solved.collect())
    assert cg.solve(grid, parameters=cg.Parameters(max_iterations=1, relative=1e-10))[1].status == "limit"
    assert cg.status(float("nan"), 1.0, 1, cg.Parameters()) == "error" and cg.status(1e6, 1.0, 1, cg.Parameters()) == "error"


def numpy_step(f, kind, omega):
    n = kind.shape[0]
    out = f.copy()
    for x in range(n):
        for y in range(n):
            for z in range(n):
                if kind[x, y, z]:
                    continue
                g = np.empty(19)
                for q, c in enumerate(C19):
                    s = (x - c[0], y - c[1], z - c[2])
                    g[q] = f[x, y, z, q] if not any(c) else f[s][q] if not kind[s] else f[x, y, z, OPPOSITE_19[q]] + f[s][OPPOSITE_19[q]]
                rho = g.sum()
                u = g @ np.array(C19) / rho
                cu = np.array(C19) @ u
                out[x, y, z] = (1 - omega) * g + omega * rho * np.array(W19) * (1 + 3 * cu + 4.5 * cu**2 - 1.5 * u @ u)
    return out


def test_lattice_boltzmann(spark, tmp_path):
    for c, w, o in ((C19, W19, OPPOSITE_19), (C27, W27, OPPOSITE_27)):
        assert sum(w) == pytest.approx(1) and all(c[o[q]] == tuple(-a for a in c[q]) for q in range(len(c)))
    cavity = Cavity(6)
    start = uniform.cavity(spark, cavity)
    f, kind = np.zeros((6, 6, 6, 19)), np.zeros((6, 6, 6), int)
    for r in start.collect():
        f[r.x, r.y, r.z], kind[r.x, r.y, r.z] = r.f, r.kind
    mass = uniform.mass(start).first().mass
    state = uniform.run(start, cavity.omega, 3, cut_every=1)
    for _ in range(3):
        f = numpy_step(f, kind, cavity.omega)
    assert all(np.allclose(r.f, f[r.x, r.y, r.z], atol=1e-12) for r in state.collect())
    blocks = uniform.run(start, cavity.omega, 3, cut_every=1, blocks=True)
    assert all(np.allclose(r.f, f[r.x, r.y, r.z], atol=1e-12) for r in blocks.collect()) and blocks.count() == 6**3
    assert uniform.mass(state).first().mass == pytest.approx(mass, rel=1e-3)
    line = uniform.centre_line(uniform.export(state), 6, "y", "ux", cavity.lid)
    sinks.write_profile(str(tmp_path / "u.dat"), line)
    assert len((tmp_path / "u.dat").read_text().splitlines()) == 6


def test_sinks(spark, tmp_path):
    grid, field = linear(spark, (3, 2, 2))
    sinks.write_vtk(str(tmp_path / "a.vtk"), field.filter("v <> 5"), grid, {"v": ["v"]}, outside=-1.0)
    lines = (tmp_path / "a.vtk").read_text().splitlines()
    assert lines[4] == "DIMENSIONS 4 3 3" and lines[-12:] == ["1", "2", "3", "4", "-1", "6", "7", "8", "9", "10", "11", "12"]
    sinks.write_vtk(str(tmp_path / "b.vtk"), field, grid, {"v": ["v"], "w": ["v", "v", "v"]}, node=True, binary=True)
    assert (tmp_path / "b.vtk").read_bytes().count(b"POINT_DATA 12") == 1
    sinks.write_vti(str(tmp_path / "a.vti"), field, grid, {"v": ["v"]})
    import base64
    import re

    data = re.search(rb"format=\"binary\">\n(.*)\n", (tmp_path / "a.vti").read_bytes())[1]
    assert np.frombuffer(base64.b64decode(data[12:]), "<f8").tolist() == [float(k) for k in range(1, 13)]
    cells = multires.build(spark, GridSpec(4, 4, 4), [F.col("x") < 2, F.lit(True)])
    assert sinks.write_levels(str(tmp_path / "m.vtk"), cells.withColumn("v", F.col("level")), "v") == cells.filter("NOT refined").count()
    assert sinks.hexahedra(cells).count() == 8 * cells.filter("NOT refined").count()
    sinks.write_report(str(tmp_path / "r.json"), {"a": 1, "b": {"c": [2]}})
    assert '"c"' in (tmp_path / "r.json").read_text()
    assert [z for z, _ in sinks.planes(field, ["v"])] == [0, 1]


def test_command_line(spark, tmp_path, capsys):
    from gridloom.__main__ import main

    assert main([]) == 0 and "g049_laplace_count" in capsys.readouterr().out
    assert main(["nothing"]) == 2
    assert main(["g001_dense_grid", "--report", str(tmp_path / "r.json"), "--show", "1"]) == 0
    assert '"rows": 2210' in (tmp_path / "r.json").read_text()


def test_scans_read_only_what_they_need(spark):
    from gridloom import queries

    plan = queries.QUERIES["g049_laplace_count"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan and plan.count("Exchange ") == 1


def test_box_predicate(spark):
    grid = GridSpec(3, 4, 5)
    rows = spark.range(-2, 8).select(F.col("id").cast("int").alias("x"), F.lit(3).alias("y"), F.lit(4).alias("z"))
    assert [r.x for r in rows.filter(grid.inside(*map(F.col, COORDS))).collect()] == [0, 1, 2]


@pytest.mark.parametrize("form", ["text", ">f8", "<f8"])
def test_pieces_cover_the_box(spark, monkeypatch, form):
    grid, field = linear(spark, (3, 5, 4))
    monkeypatch.setattr(sinks, "CHUNK", 7)
    some = field.filter("z <> 2 AND v <> 4")
    want = np.arange(1.0, 61.0)
    want[(want == 4) | ((want > 30) & (want <= 45))] = -1
    got = b"".join(sinks.pieces(some, grid, ["v"], form, -1.0))
    assert got == sinks.encode(want.reshape(-1, 1), form)
    assert b"".join(sinks.pieces(field.limit(0), grid, ["v", "v"], form, 2.0)) == sinks.encode(np.full((60, 2), 2.0), form)


def test_domain_file(spark, tmp_path):
    grid, field = linear(spark, (2, 2, 3))
    sinks.write_domain(str(tmp_path / "d.vtk"), field.filter("v <> 1"), grid, 2)
    assert (tmp_path / "d.vtk").read_text().splitlines()[-12:] == ["-1", *["0"] * 7, *["1"] * 4]


def test_halo_update(spark):
    grid, field = linear(spark, (2, 2, 9))
    bounds = partitions.slab_bounds(9, 3)
    got = {(r["slab"], r["z"], r["ghost"]) for r in partitions.halo_update(field, bounds).collect()}
    assert got == {(s, z, not low <= z < high) for s, (low, high) in enumerate(bounds) for z in range(max(0, low - 1), min(9, high + 1))}
    assert not partitions.halo_update(field, [(0, 9)]).filter("ghost").count()
    for bad in ({"semantic": "streaming"}, {"radius": 2}):
        with pytest.raises(ValueError):
            partitions.halo_update(field, bounds, **bad)


def test_load_modes(spark):
    cells = multires.build(spark, GridSpec(4, 4, 4), [F.col("x") < 2, F.lit(True)]).withColumn("v", F.col("x"))
    assert multires.load(cells, 0, 2, "v", multires.STENCIL_UP).filter("has_parent").count() == 32
    assert multires.load(cells, 1, 2, "v", multires.STENCIL_DOWN).filter("children = 8").count() == 4
    assert multires.load(cells, 1, 2, "v", multires.STENCIL_DOWN).count() == 8
    assert multires.load(cells, 0, 2, "v", multires.STENCIL).columns[-1] == "valid5"
    for level, mode in ((1, multires.STENCIL_UP), (0, multires.STENCIL_DOWN), (2, multires.MAP), (0, "sideways")):
        with pytest.raises(ValueError):
            multires.load(cells, level, 2, "v", mode)
    with pytest.raises(ValueError):
        multires.on_level(cells, 0, 2, "v", "v", lambda r: F.col("v"), multires.STENCIL)
    total = multires.on_level(cells, 1, 2, "v", "sum", lambda r: F.col("child_sum"), multires.STENCIL_DOWN)
    assert total.count() == cells.count() and total.agg(F.sum("sum")).first()[0] == 16


def test_reduce_with(spark):
    _, field = linear(spark, (2, 2, 3))
    field = field.withColumn("v", F.when(F.col("v") != 6, F.col("v")))
    assert reductions.reduce_with(field, "v", np.maximum, -1).first()[0] == 12
    assert reductions.reduce_with(field.limit(0), "v", np.add, 0).first()[0] == 0
    with pytest.raises(TypeError):
        reductions.dot(field.withColumn("s", F.lit("a")), "v", "s")
    with pytest.raises(TypeError):
        reductions.dot(field.withColumn("s", F.lit(0.5)), "v", "s")


def test_plans_are_edited():
    op = lambda name, reads, writes: Operator(name, reads, writes, lambda env: env)
    inner = Pipeline("inner").sequence(op("a", (), ("f",)), op("b", (), ("g",))).depend("a", "b")
    plan = Pipeline("outer").sequence(inner, op("c", ("f",), ("h",))).depend("b", "c")
    other = plan.clone("copy")
    assert [o.name for o in other.remove("b").flat()] == ["a", "c"] and not other.edges()
    assert [o.name for o in plan.flat()] == ["a", "b", "c"]
    whole = plan.expand()
    assert whole.steps == plan.flat() and whole.dependencies() == plan.dependencies()
    assert ("a", "b", "manual") in whole.dependencies()
    assert [o.name for o in plan.remove("inner").add(op("d", (), ("k",))).flat()] == ["c", "d"] and not plan.edges()
    with pytest.raises(KeyError):
        plan.remove("nothing")


def test_whole_sums_beyond_a_bigint(spark):
    """Products and sums of whole numbers are exact, and BIGINT where they fit."""
    big, n = 2**40, 5
    field = spark.range(n).select(F.lit(big).alias("v"), F.lit(big).alias("w"), (F.col("id") % 2).cast("string").alias("data_view"))
    assert reductions.narrowed(reductions.dot(field, "v", "w"), "dot").first().dot == n * big * big
    views = reductions.narrowed(reductions.by_view(field.withColumn("v", F.lit(2**62)), F.col("v")), "total")
    assert {r.data_view: r.total for r in views.collect()} == {"0": 3 * 2**62, "1": 2 * 2**62, "STANDARD": n * 2**62}
    assert reductions.absolute_sum(field.withColumn("v", F.lit(-(2**62))), "v").first().abs_sum == n * 2**62
    few = reductions.narrowed(reductions.dot(field.withColumns({"v": F.lit(2), "w": F.lit(-3)}), "v", "w"), "dot")
    assert few.schema["dot"].dataType.simpleString() == "bigint" and few.first().dot == -6 * n
