"""Lattice-Boltzmann flow on a uniform grid.

A frame has x, y, z, kind (BULK, BOUNCE_BACK, MOVING_WALL), wall (bits of directions whose source isn't bulk) and f, an
array of populations. A step takes one shuffle: each cell sends its populations to the cells that pull them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.lbm.lattice import C19, CENTER, OPPOSITE_19, W19, Cavity
from gridloom.operators import packed
from gridloom.operators.halo import SIZE, blockwise, shift
from gridloom.plans.checkpoint import cut
from gridloom.sources.cells import dense
from gridloom.spec import COORDS, GridSpec, Stencil

BULK, BOUNCE_BACK, MOVING_WALL = 0, 1, 2
Q = len(C19)


def total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def cavity(spark: SparkSession, c: Cavity) -> DataFrame:
    """The cavity at rest: weights inside, nothing at walls, the lid's momentum at its plane."""
    cells = dense(spark, GridSpec(c.n, c.n, c.n))
    edge = reduce(lambda a, b: a | b, [(F.col(a) == 0) | (F.col(a) == c.n - 1) for a in COORDS])
    lid = F.col("y") == c.n - 1
    kind = F.when(~edge, BULK).when(lid, MOVING_WALL).otherwise(BOUNCE_BACK)
    f = F.array(*[F.when(~edge, w).when(lid, -6.0 * w * c.lid * d[0]).otherwise(0.0) for w, d in zip(W19, C19, strict=True)])
    return wall_mask(cells.select(*COORDS, kind.alias("kind"), f.alias("f")))


def wall_mask(cells: DataFrame) -> DataFrame:
    """wall: for bulk cells, bit q is set where the cell that population q comes from isn't bulk; 0 elsewhere."""
    sources = Stencil(tuple(tuple(-a for a in c) for c in C19))
    slots = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip((q, *o), ("q", "dx", "dy", "dz"), strict=True)]) for q, o in enumerate(sources)])
    rows = cells.select(*COORDS, "kind", F.when(F.lit(True), F.col("f")).alias("f"), F.explode(slots).alias("o"))
    moved = rows.select(*[(F.col(c) - F.col(f"o.d{c}")).cast("int").alias(c) for c in COORDS], F.col("o.q").alias("q"), "kind", F.when(F.col("o.q") == CENTER, F.col("f")).alias("f"))
    sent = F.col("q") != CENTER
    bulk = F.sum(F.when(sent & (F.col("kind") == BULK), F.call_function("shiftleft", F.lit(1), F.col("q"))).otherwise(0))
    every = sum(1 << q for q in range(Q) if q != CENTER)
    out = moved.groupBy(*COORDS).agg(F.max(F.when(~sent, F.col("kind"))).alias("kind"), F.max("f").alias("f"), bulk.alias("b"))
    out = out.filter(F.col("kind").isNotNull())
    wall = F.when(F.col("kind") == BULK, F.lit(every).cast("long") - F.col("b")).otherwise(F.lit(0).cast("long"))
    return out.select(*COORDS, "kind", wall.alias("wall"), "f")


def pull(cells: DataFrame) -> DataFrame:
    """Adds g, the populations after streaming: from the source cell, or bounced back with the wall's own share."""
    slots = F.array(*[
        F.struct(F.lit(q).alias("q"), *[F.lit(a).alias(f"d{n}") for a, n in zip(C19[q], COORDS, strict=True)], F.col("f")[q].alias("a"), F.col("f")[OPPOSITE_19[q]].alias("b"))
        for q in range(Q)
    ])
    rows = cells.select(*COORDS, "kind", "wall", "f", F.explode(slots).alias("o"))
    center = F.col("o.q") == CENTER
    rows = rows.select(
        *[(F.col(c) + F.col(f"o.d{c}")).cast("int").alias(c) for c in COORDS], F.col("o.q").alias("q"), F.col("o.a").alias("a"), F.col("o.b").alias("b"),
        *[F.when(center, F.col(c)).alias(c) for c in ("kind", "wall", "f")],
    )
    at = lambda q, c: F.max(F.when(F.col("q") == q, F.col(c)))
    got = rows.groupBy(*COORDS).agg(
        *[F.max(c).alias(c) for c in ("kind", "wall", "f")], F.array(*[at(q, "a") for q in range(Q)]).alias("a"), F.array(*[at(q, "b") for q in range(Q)]).alias("b")
    ).filter(F.col("kind").isNotNull())
    wall = lambda q: F.col("wall").bitwiseAND(F.lit(1 << q)) != 0
    g = [F.col("f")[q] if q == CENTER else F.when(wall(q), F.col("f")[OPPOSITE_19[q]] + F.col("b")[q]).otherwise(F.col("a")[q]) for q in range(Q)]
    return got.select(*COORDS, "kind", "wall", "f", F.array(*g).alias("g"))


def macroscopic(populations: str) -> list[Column]:
    """rho, ux, uy, uz of an array of populations."""
    p = [F.col(populations)[q] for q in range(Q)]
    rho = total(p)
    axis = lambda k: total([v for v, c in zip(p, C19, strict=True) if c[k] == 1]) - total([v for v, c in zip(p, C19, strict=True) if c[k] == -1])
    return [rho.alias("rho"), *[(axis(k) / rho).alias(f"u{c}") for k, c in enumerate(COORDS)]]


def equilibrium(q: int) -> Column:
    cu = total([F.col(f"u{n}") * float(a) for a, n in zip(C19[q], COORDS, strict=True)])
    usqr = 1.5 * total([F.col(f"u{n}") * F.col(f"u{n}") for n in COORDS])
    return F.col("rho") * W19[q] * (1.0 + 3.0 * cu + 4.5 * cu * cu - usqr)


def collide(omega: float, populations: str) -> Column:
    """Relaxation toward the second-order equilibrium of rho, ux, uy, uz."""
    return F.array(*[(1.0 - omega) * F.col(populations)[q] + omega * equilibrium(q) for q in range(Q)])


def step(cells: DataFrame, omega: float) -> DataFrame:
    """Streaming, moments and collision of bulk cells; other cells keep their populations."""
    got = pull(cells)
    rho, *u = macroscopic("g")
    safe = got.withColumn("_bulk", F.col("kind") == BULK).withColumn("g", F.when(F.col("_bulk"), F.col("g")).otherwise(F.array(*[F.lit(w) for w in W19])))
    moments = safe.select("*", rho, *u)
    return moments.select(*COORDS, "kind", "wall", F.when(F.col("_bulk"), collide(omega, "g")).otherwise(F.col("f")).alias("f"))


def step_blocks(cells: DataFrame, omega: float, size: int = SIZE) -> DataFrame:
    """The same step on packed blocks: a third more rows than cells are shuffled, not nineteen times as many."""
    c, w = np.array(C19, float), np.array(W19)

    def kernel(values: dict[str, np.ndarray], valid: np.ndarray) -> dict[str, np.ndarray]:
        f, wall = values["f"], values["wall"]
        bulk = valid & (values["kind"] == BULK)
        g = np.empty_like(f)
        for q, d in enumerate(C19):
            source, back = [-a for a in d], OPPOSITE_19[q]
            bounced = f[..., back] + shift(f[..., back], source)
            g[..., q] = f[..., q] if q == CENTER else np.where(wall >> q & 1, bounced, shift(f[..., q], source))
        g = g[bulk]
        rho = g.sum(1, keepdims=True)
        u = g @ c / rho
        cu = u @ c.T
        eq = rho * w * (1.0 + 3.0 * cu + 4.5 * cu * cu - 1.5 * (u * u).sum(1, keepdims=True))
        out = f.copy()
        out[bulk] = (1.0 - omega) * g + omega * eq
        return {"kind": values["kind"], "wall": wall, "f": out}

    fields = [T.StructField("kind", T.IntegerType()), T.StructField("wall", T.LongType()), T.StructField("f", T.ArrayType(T.DoubleType()))]
    return blockwise(cells, ["kind", "wall", "f"], kernel, T.StructType(fields), size)


PULLED = Stencil(tuple(tuple(-a for a in c) for c in C19 if any(c)))


def sent(name: str, step: tuple[int, int, int]) -> list[int] | None:
    """Of the populations, those that cells pull from a block that lies against the step, and those that walls there give back."""
    if name != "f":
        return None
    along = [q for q, c in enumerate(C19) if all(a == s for a, s in zip(c, step, strict=True) if s)]
    return sorted({*along, *(OPPOSITE_19[q] for q in along)})


def pack(cells: DataFrame, size: int = packed.SIZE) -> packed.Packed:
    return packed.pack(cells, ["kind", "wall", "f"], size, {"f": Q})


def relax(omega: float) -> packed.Kernel:
    """Streaming, moments and collision on packed blocks."""
    c, w = np.array(C19, float), np.array(W19)

    def kernel(h: packed.Halo) -> dict[str, np.ndarray]:
        wall, bulk = h.at("wall"), h.at(None) & (h.at("kind") == BULK)
        g = np.empty_like(h.at("f"))
        for q, d in enumerate(C19):
            source, back = tuple(-a for a in d), OPPOSITE_19[q]
            if q == CENTER:
                g[..., q] = h.at("f", component=q)
            else:
                g[..., q] = np.where(wall >> q & 1, h.at("f", component=back) + h.at("f", source, back), h.at("f", source, q))
        g = g[bulk]
        rho = g.sum(1, keepdims=True)
        u = g @ c / rho
        cu = u @ c.T
        eq = rho * w * (1.0 + 3.0 * cu + 4.5 * cu * cu - 1.5 * (u * u).sum(1, keepdims=True))
        out = h.at("f").copy()
        out[bulk] = (1.0 - omega) * g + omega * eq
        return {"f": out}

    return kernel


def run_packed(table: packed.Packed, omega: float, steps: int) -> packed.Packed:
    """steps in a row on a packed table: only the populations that cross a face are shuffled, blocks stay where they are."""
    return packed.iterate(table, steps, relax(omega), [table.field("f")], ["f"], PULLED, sent, ["kind", "wall"], ["kind", "wall"])


def run(cells: DataFrame, omega: float, steps: int, cut_every: int = 5, blocks: bool = False) -> DataFrame:
    """steps in a row, by columns or on packed blocks; every few of them the state is written to the shared folder."""
    for k in range(steps):
        cells = step_blocks(cells, omega) if blocks else step(cells, omega)
        if (k + 1) % cut_every == 0:
            cells = cut(cells, "lbm")
    return cells


def export(cells: DataFrame) -> DataFrame:
    """x, y, z, rho, ux, uy, uz: of streamed populations in bulk, of the wall's own at the lid, 0 elsewhere."""
    got = pull(cells).withColumn("g", F.when(F.col("kind") == BULK, F.col("g")).otherwise(F.array(*[F.lit(w) for w in W19])))
    got = got.select("*", *macroscopic("g"))
    bulk, lid = F.col("kind") == BULK, F.col("kind") == MOVING_WALL
    rho = F.when(bulk, F.col("rho")).when(lid, 1.0).otherwise(0.0)
    u = [F.when(bulk, F.col(f"u{c}")).when(lid, F.col("f")[k] / (6.0 / 18.0)).otherwise(0.0).alias(f"u{c}") for k, c in enumerate(COORDS)]
    return got.select(*COORDS, rho.alias("rho"), *u)


def centre_line(moments: DataFrame, n: int, along: str, value: str, lid: float) -> DataFrame:
    """pos and value along one axis through the middle, in units of the cavity and of the lid's speed."""
    others = [c for c in COORDS if c != along]
    middle = reduce(lambda a, b: a & b, [F.col(c) == n // 2 for c in others])
    return moments.filter(middle).select((F.col(along) / F.lit(float(n))).alias("pos"), (F.col(value) / lid).alias("value"))


def mass(cells: DataFrame) -> DataFrame:
    return cells.filter(F.col("kind") == BULK).agg(F.sum(F.aggregate("f", F.lit(0.0), lambda a, v: a + v)).alias("mass"))
