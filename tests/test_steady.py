"""Flow until it is steady, and centre lines held against published profiles."""

import numpy as np
import pytest

from gridloom.lbm import steady, uniform, verify
from gridloom.lbm.lattice import C19, Cavity
from gridloom.operators import packed
from gridloom.plans import checkpoint


def test_a_run_ends_when_velocities_hardly_change(spark):
    c = Cavity(6, reynolds=4.0, lid=0.1)
    start = uniform.pack(uniform.cavity(spark, c), 4)
    before = set(checkpoint.PLACES)
    out, end = steady.settle(start, c.omega, 1e-4, 60, 8)
    assert end.steady and end.change < 1e-4 and end.steps % 8 == 0 and end.steps < 60
    assert set(checkpoint.PLACES) - before == {out.table}
    # One more step changes as little as told, or less; a run that may not go on says so.
    rows = {}
    for name, table in (("now", out), ("next", uniform.run_packed(out, c.omega, 1))):
        fluid = [r for r in packed.unpack(table).collect() if r.kind == 0]
        f = np.array([r.f for r in sorted(fluid, key=lambda r: (r.x, r.y, r.z))])
        rows[name] = f @ np.array(C19, float) / f.sum(1, keepdims=True)
    assert np.abs(rows["next"] - rows["now"]).sum(1).mean() <= end.change * 1.05
    assert not steady.settle(start, c.omega, 0.0, 3, 2)[1].steady
    line = sorted((r.pos, r.value) for r in uniform.centre_line(uniform.export(packed.unpack(out)), 6, "y", "ux", c.lid).collect())
    assert line[-1][1] == pytest.approx(1.0) and min(v for _, v in line) < 0 < line[-2][1]


def test_profiles_are_read_between_samples(spark):
    samples = sorted({*np.linspace(0.05, 0.95, 37).round(6).tolist(), 0.5, 0.4531})
    profile = spark.createDataFrame([(float(p), float(p**3 - 0.2)) for p in samples], "pos double, value double").repartition(5)
    points = spark.createDataFrame(list(zip(verify.Y_POSITIONS, verify.U_ALONG_Y[100], strict=True)), "pos double, expected double")
    got = {r.pos: r.value for r in verify.interpolated(profile, points).collect()}
    want = np.interp(verify.Y_POSITIONS, samples, [p**3 - 0.2 for p in samples])
    assert len(got) == 17 and all(abs(got[p] - w) < 1e-12 for p, w in zip(verify.Y_POSITIONS, want, strict=True))
    exact = points.selectExpr("pos", "expected AS value")
    assert verify.worst_error(exact, 100).first().error == 0
    plan = verify.interpolated(profile, points)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
