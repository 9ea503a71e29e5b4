"""Multi-resolution flow and the entropic collision against loops over dictionaries."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.lbm import multires as lbm
from gridloom.lbm.lattice import C19, C27, OPPOSITE_19, W19, W27
from gridloom.operators.multires import build, omega, uncle_offset
from gridloom.spec import GridSpec

C, W, Q = [np.array(c) for c in C19], np.array(W19), 19


class Plain:
    """The step on dictionaries keyed by (level, x, y, z)."""

    def __init__(self, rows, levels):
        self.levels = levels
        self.kind = {k: r["kind"] for k, r in rows.items()}
        self.refined = {k: r["refined"] for k, r in rows.items()}
        self.f = {k: np.array(r["f"]) for k, r in rows.items()}
        self.o = {k: np.array(r["o"]) for k, r in rows.items()}
        self.weight = {k: np.zeros(Q) for k in rows}
        for k in rows:
            for q, target in self.targets(k, children=False):
                self.weight[target][q] += 1
        self.weight = {k: np.where(v > 0.001, 1 / np.maximum(2 * v, 1e-9), 0) for k, v in self.weight.items()}

    def near(self, k, d, by=1):
        return (k[0], *[int(a + b * by * (1 << k[0])) for a, b in zip(k[1:], d, strict=True)])

    def parent(self, k, d=(0, 0, 0)):
        w = 2 << k[0]
        return (k[0] + 1, *[int(a // w * w + b * w) for a, b in zip(k[1:], d, strict=True)])

    def targets(self, k, children):
        local = [a // (1 << k[0]) % 2 for a in k[1:]]
        if k[0] == self.levels - 1 or self.parent(k) not in self.kind:
            return
        for q, c in enumerate(C):
            if not c.any():
                continue
            u = [uncle_offset(i, int(a)) for i, a in zip(local, c, strict=True)]
            if self.near(k, u) in self.kind or self.parent(k, u) not in self.kind:
                continue
            back = [a - b for a, b in zip(u, c, strict=True)]
            if self.parent(k, back) in self.kind and (not children or self.near(k, back) in self.kind):
                yield q, self.parent(k, back)

    def collide(self, level, omega0):
        rate = omega(omega0, level, self.levels)
        for k in self.kind:
            if k[0] != level or self.kind[k]:
                continue
            if self.refined[k]:
                self.o[k] = np.zeros(Q) if level else self.o[k]
                continue
            g = self.f[k]
            u = g @ np.array(C) / g.sum()
            cu = np.array(C) @ u
            self.o[k] = (1 - rate) * g + rate * g.sum() * W * (1 + 3 * cu + 4.5 * cu**2 - 1.5 * u @ u)

    def store(self, level):
        for k in self.kind:
            if k[0] == level and not self.refined[k]:
                for q, target in self.targets(k, children=True):
                    self.o[target][q] += self.o[k][q]

    def stream(self, level):
        for k in self.kind:
            if k[0] != level or self.refined[k]:
                continue
            local = [a // (1 << level) % 2 for a in k[1:]]
            for q, c in enumerate(C):
                p = self.near(k, -c)
                if not c.any():
                    if not self.kind[k]:
                        self.f[k][q] = self.o[k][q]
                elif p in self.kind:
                    if self.refined[p]:
                        self.f[k][q] = self.o[p][q] * self.weight[p][q]
                    elif not self.kind[k]:
                        self.f[k][q] = self.o[p][q] if not self.kind[p] else self.o[k][OPPOSITE_19[q]] + self.o[p][OPPOSITE_19[q]]
                elif level < self.levels - 1 and self.parent(k) in self.kind:
                    up = self.parent(k, [uncle_offset(i, int(-a)) for i, a in zip(local, c, strict=True)])
                    if up in self.kind:
                        self.f[k][q] = self.o[up][q]

    def advance(self, level, omega0):
        for _ in range(1 if level == self.levels - 1 else 2):
            self.collide(level, omega0)
            if level < self.levels - 1:
                self.store(level)
            if level:
                self.advance(level - 1, omega0)
            self.stream(level)


def test_levels(spark):
    grid = GridSpec(12, 8, 8)
    cells = build(spark, grid, [F.col("x") < 6, F.lit(True)])
    state = lbm.at_rest(cells, (12, 8, 8), 2, C19, W19, 0.05)
    plain = Plain({(r.level, r.x, r.y, r.z): r.asDict() for r in state.collect()}, 2)
    got = {(r.level, r.x, r.y, r.z): r for r in state.collect()}
    assert all(np.allclose(got[k].weight, v) for k, v in plain.weight.items()) and any(v.any() for v in plain.weight.values())
    state = lbm.advance(state, 1, 2, 1.5, C19, W19)
    plain.advance(1, 1.5)
    got = {(r.level, r.x, r.y, r.z): r for r in state.collect()}
    assert got.keys() == plain.kind.keys()
    for k in got:
        assert np.allclose(got[k].o, plain.o[k], atol=1e-12) and np.allclose(got[k].f, plain.f[k], atol=1e-12), k
    mean = lbm.store_coarse(state, 1, C19)
    assert mean.count() == len(got)


def test_kbc(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in np.array(W27) * rng.uniform(0.9, 1.1, 27)]) for i in range(20)]
    got = {r.i: np.array(r.o) for r in lbm.collide_kbc(spark.createDataFrame(rows, "i int, f array<double>"), C27, W27, 1.7).collect()}
    c, w, beta = np.array(C27), np.array(W27), 0.85
    for i, f in rows:
        f = np.array(f)
        rho = f.sum()
        u = f @ c / rho
        cu = 3 * c @ u
        eq = rho * w * (1 + cu + 0.5 * cu**2 - 1.5 * u @ u)
        pi = np.einsum("q,qa,qb->ab", f - eq, c, c)
        xz, yz = pi[0, 0] - pi[2, 2], pi[1, 1] - pi[2, 2]
        s = np.zeros(27)
        for q, d in enumerate(C27):
            moved = [k for k in range(3) if d[k]]
            if len(moved) == 1:
                s[q] = [(2 * xz - yz) / 6, (-xz + 2 * yz) / 6, (-xz - yz) / 6][moved[0]]
            elif len(moved) == 2:
                s[q] = d[moved[0]] * d[moved[1]] * pi[moved[0], moved[1]] / 4
        s *= rho
        h = f - eq - s
        gamma = 1 / beta - (2 - 1 / beta) * (s * h / eq).sum() / (1e-7 + (h * h / eq).sum())
        assert np.allclose(got[i], f - beta * (2 * s + gamma * h), atol=1e-14)
        assert math.isclose(got[i].sum(), rho, rel_tol=1e-12)


def test_generic_bgk_and_channel(spark):
    rows = spark.createDataFrame([(0, [float(v) for v in W19])], "i int, f array<double>")
    assert np.allclose(lbm.collide_bgk(rows, C19, W19, 1.2).first().o, W19)
    cells = build(spark, GridSpec(8, 8, 8), [F.col("x") < 4, F.lit(True)])
    kinds = lbm.flow_over(cells, (8, 8, 8), (F.col("x") == 2) & (F.col("y") == 2), 0.1, C19, W19)
    assert {r.kind for r in kinds.select("kind").distinct().collect()} == {0, 1, 2}
    with pytest.raises(ValueError, match="not in tuple"):
        lbm.opposite(((1, 0, 0),), 0)


def test_sums_of_a_collision_are_worked_out_once(spark):
    """Written out as columns, rho and u are found anew in every term of every direction."""
    from gridloom.lbm.lattice import C27, W27

    rows = spark.range(50).select(F.array(*[F.lit(v) * (1.0 + F.col("id") % 7 / (q + 9.0)) for q, v in enumerate(W27)]).alias("f"))
    made = lbm.collide_bgk(rows, C27, W27, 1.2)
    assert "aggregate(" not in made._jdf.queryExecution().optimizedPlan().toString()
    for r in made.collect():
        g, d, w = np.array(r.f), np.array(C27, float), np.array(W27)
        u = g @ d / g.sum()
        eq = g.sum() * w * (1 + 3 * d @ u + 4.5 * (d @ u) ** 2 - 1.5 * u @ u)
        assert np.allclose(r.o, -0.2 * g + 1.2 * eq)
    null = rows.select(F.when(F.lit(False), F.col("f")).alias("f")).limit(1)
    assert lbm.collide_bgk(null, C27, W27, 1.2).first().o is None


def test_cells_travel_once_in_the_tau_form(spark):
    """Not once per direction; columns that the form doesn't know stay with their cells."""
    from gridloom.lbm import boundaries

    cells = spark.range(20 * 3 * 3).selectExpr("int(id % 20 - 2) AS x", "int(id DIV 20 % 3) AS y", "int(id DIV 60) AS z", "int(id % 5 > 0) AS mask", "string(id) AS name")
    rows = cells.withColumn("f", F.array(*[F.lit(v) * (1.0 + (F.col("x") + q) % 7 / 50.0) for q, v in enumerate(W19)])).withColumns({"rho": F.lit(1.1), "ux": F.lit(0.02), "uy": F.lit(0.0), "uz": F.lit(-0.01)})
    made = boundaries.tau_collide_stream(rows, C19, W19, 0.8)
    assert "SortAggregate" not in made._jdf.queryExecution().executedPlan().toString()
    have = {(r.x, r.y, r.z): r for r in rows.collect()}
    u = np.array([0.02, 0.0, -0.01])
    assert made.count() == len(have)
    for r in made.collect():
        own = have[r.x, r.y, r.z]
        assert r.name == own.name and r.mask == own.mask
        want = list(own.f)
        for q, (d, t) in enumerate(zip(C19, W19, strict=True)) if own.mask else ():
            at = have.get(tuple(a - b for a, b in zip((r.x, r.y, r.z), d, strict=True)))
            want[q] = 0.0 if at is None else (1 - 1 / 0.8) * at.f[q] + 1.1 * t * (1 + 3 * np.dot(d, u) + 4.5 * np.dot(d, u) ** 2 - 1.5 * u @ u) / 0.8
        assert np.allclose(r.f, want)
