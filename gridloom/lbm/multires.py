"""Lattice-Boltzmann flow on a multi-resolution grid, and the entropic (KBC) collision.

A frame has level, x, y, z, refined, kind, f (populations after streaming) and o (after collision). On refined cells o gathers
what finer cells send to a coarse neighbour. Positions are in finest units; a cell of level l is 2^l wide.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.lbm.uniform import BOUNCE_BACK, BULK, MOVING_WALL
from gridloom.operators.multires import LEVEL_COORDS, omega, width
from gridloom.plans.checkpoint import cut
from gridloom.spec import COORDS, GridSpec

Lattice = tuple[tuple[tuple[int, int, int], ...], tuple[float, ...], tuple[int, ...]]


def opposite(c: Sequence[tuple[int, int, int]], q: int) -> int:
    return c.index(tuple(-a for a in c[q]))


def moments(c: Sequence[tuple[int, int, int]], populations: str) -> list[Column]:
    """rho and velocity of an array of populations."""
    rho = F.aggregate(populations, F.lit(0.0), lambda a, v: a + v)
    sums = [reduce(lambda a, b: a + b, [F.col(populations)[q] * float(d[k]) for q, d in enumerate(c) if d[k]]) for k in range(3)]
    return [rho.alias("rho"), *[(s / rho).alias(f"u{n}") for s, n in zip(sums, COORDS, strict=True)]]


def numbers(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A column of doubles, or of lists of them with one length, as [row] or [row, component]; nulls are not numbers."""
    if width is None:
        return column.to_numpy(zero_copy_only=False)
    if column.null_count:
        out = np.full((len(column), width), np.nan)
        out[np.asarray(column.is_valid())] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        return out
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def arrays(values: np.ndarray, known: np.ndarray) -> pa.Array:
    """[row, component] as a list per row, null where a row isn't known."""
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).ravel()), mask=pa.array(~known) if not known.all() else None)


def second_order(c: Sequence[tuple[int, int, int]], w: Sequence[float]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """(rho [row], u [row, 3]) -> second-order equilibria [row, direction]."""
    d, weights = np.array(c, float), np.array(w)

    def of(rho: np.ndarray, u: np.ndarray) -> np.ndarray:
        cu = 3.0 * (u @ d.T)
        return rho[:, None] * weights * (1.0 + cu + 0.5 * cu * cu - 1.5 * (u * u).sum(1, keepdims=True))

    return of


def equilibria(c: Sequence[tuple[int, int, int]], w: Sequence[float]) -> Column:
    """The array of second-order equilibria of rho, ux, uy, uz.

    As columns, the planner writes the sums behind rho and u out anew in every term of every direction; as a function of Arrow batches it gets each once.
    """
    second = second_order(c, w)

    @F.arrow_udf("array<double>")
    def kernel(rho: pa.Array, ux: pa.Array, uy: pa.Array, uz: pa.Array) -> pa.Array:
        known = np.logical_and.reduce([np.asarray(a.is_valid()) for a in (rho, ux, uy, uz)])
        return arrays(second(numbers(rho), np.stack([numbers(a) for a in (ux, uy, uz)], axis=1)), known)

    return kernel(*[F.col(n).cast("double") for n in ("rho", "ux", "uy", "uz")])


def collide_bgk(cells: DataFrame, c: Sequence, w: Sequence[float], rate: Column | float, f: str = "f", out: str = "o") -> DataFrame:
    """(1 - rate) f + rate f_eq, whatever the lattice. Runs on Arrow batches in NumPy, as collide_kbc does."""
    d, second = np.array(c, float), second_order(c, w)

    @F.arrow_udf("array<double>")
    def kernel(populations: pa.Array, rates: pa.Array) -> pa.Array:
        known = np.asarray(populations.is_valid())
        g, r = numbers(populations, len(d)), numbers(rates)[:, None]
        rho = g.sum(1)
        if (rho == 0).any():
            raise ZeroDivisionError("a cell without any population has no velocity")
        return arrays((1.0 - r) * g + r * second(rho, g @ d / rho[:, None]), known)

    return cells.withColumn(out, kernel(F.col(f), rate if isinstance(rate, Column) else F.lit(float(rate))))


def shear(c: Sequence[tuple[int, int, int]]) -> list[list[float]]:
    """Weights of Pi_xx, Pi_xy, Pi_xz, Pi_yy, Pi_yz, Pi_zz in each direction's shear part."""
    rows = []
    for d in c:
        moved = [k for k in range(3) if d[k]]
        if len(moved) == 1:
            rows.append([(2 if k == moved[0] else -1) / 6 if k is not None else 0.0 for k in (0, None, None, 1, None, 2)])
        elif len(moved) == 2:
            pair = {(0, 1): 1, (0, 2): 2, (1, 2): 4}[tuple(moved)]
            rows.append([d[moved[0]] * d[moved[1]] / 4 if k == pair else 0.0 for k in range(6)])
        else:
            rows.append([0.0] * 6)
    return rows


def collide_kbc(cells: DataFrame, c: Sequence, w: Sequence[float], rate: Column | float, f: str = "f", out: str = "o", tiny: float = 1e-7) -> DataFrame:
    """Entropic collision: the shear part relaxes at the rate, the rest by a factor that the local state sets.

    As columns the nested sums over directions make plans too large to compile, so this runs on Arrow batches in NumPy.
    """
    d, weights, parts = np.array(c, float), np.array(w), np.array(shear(c))

    @F.pandas_udf("array<double>")
    def kernel(populations: pd.Series, rates: pd.Series) -> pd.Series:
        if not len(populations):
            return pd.Series([], dtype=object)
        g = np.stack(populations.to_numpy())
        beta = (0.5 * rates.to_numpy(float))[:, None]
        rho = g.sum(1, keepdims=True)
        u = g @ d / rho
        cu = 3.0 * u @ d.T
        eq = rho * weights * (1.0 + cu + 0.5 * cu * cu - 1.5 * (u * u).sum(1, keepdims=True))
        rest = g - eq
        flux = np.stack([rest @ (d[:, a] * d[:, b]) for a in range(3) for b in range(a, 3)], axis=1)
        s = rho * (flux @ parts.T)
        h = rest - s
        e0, e1 = (s * h / eq).sum(1, keepdims=True), (h * h / eq).sum(1, keepdims=True)
        gamma = 1.0 / beta - (2.0 - 1.0 / beta) * e0 / (tiny + e1)
        return pd.Series(list(g - beta * (2.0 * s + gamma * h)))

    return cells.withColumn(out, kernel(F.col(f), rate if isinstance(rate, Column) else F.lit(float(rate))))


def directions(c: Sequence[tuple[int, int, int]], sign: int = 1) -> Column:
    return F.array(*[F.struct(F.lit(q).alias("q"), *[F.lit(sign * a).alias(f"d{n}") for a, n in zip(d, COORDS, strict=True)]) for q, d in enumerate(c) if any(d)])


def covering(prefix: str, level: Column, shift: Column | int = 0) -> list[Column]:
    """Origin of the cell one level up that covers a position."""
    w = width(level + 1)
    return [(F.floor(F.col(f"{prefix}{n}") / w) * w).cast("int").alias(f"u{n}") for n in COORDS]


def named(cells: DataFrame, prefix: str, *columns: str) -> DataFrame:
    """The cells under other names, for a join: <prefix>level, <prefix>x, ... and the columns."""
    return cells.select(*[F.col(n).alias(f"{prefix}{n}") for n in (*LEVEL_COORDS, *columns)])


def at(prefix: str, level: Column, place: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{prefix}level") == level, *[F.col(f"{prefix}{n}") == F.col(f"{place}{n}") for n in COORDS]])


def senders(cells: DataFrame, level: int, c: Sequence) -> DataFrame:
    """For each cell of a level with a parent and each direction into an unrefined coarse cell: the coarse cell (s) that the
    population is to be left in, which lies one coarse step before that cell."""
    w = 1 << level
    rows = cells.filter(F.col("level") == level).select(*LEVEL_COORDS, "refined", "o", F.explode(directions(c)).alias("d"))
    rows = rows.select("*", *[(F.col(n) + F.col(f"d.d{n}") * w).cast("int").alias(f"p{n}") for n in COORDS])
    rows = rows.select("*", *covering("p", F.lit(level)), *[(F.floor(F.col(n) / (2 * w)) * (2 * w)).cast("int").alias(f"m{n}") for n in COORDS])
    rows = rows.select("*", *[(F.col(f"u{n}") - F.col(f"d.d{n}") * 2 * w).alias(f"s{n}") for n in COORDS])
    # The step from the parent to s, taken at the cell's own level, tells whether s has cells where this one needs them.
    rows = rows.select("*", *[(F.col(n) + F.floor((F.col(f"s{n}") - F.col(f"m{n}")) / 2)).cast("int").alias(f"k{n}") for n in COORDS])
    fine, up = F.lit(level), F.lit(level + 1)
    rows = rows.join(named(cells, "a_"), at("a_", fine, "p"), "left_anti")
    for prefix, lv, place in (("b_", up, "u"), ("c_", up, "s"), ("e_", up, "m")):
        rows = rows.join(named(cells, prefix), at(prefix, lv, place), "left_semi")
    return rows


#: Coarse cells along the side of a block of two levels.
SIDE = 8
Boxes = dict[str, np.ndarray]


def two_levels(cells: DataFrame, level: int, reach: int, columns: Sequence[str], kernel: Callable[[Boxes, Boxes], Boxes], target: int, column: str) -> DataFrame:
    """All cells, with a column of one level set by a kernel that sees a level and the one above it in blocks. One shuffle.

    A block is SIDE coarse cells wide and holds the cells of both levels in it, and those within `reach` coarse cells around. The kernel gets
    boxes [z, y, x] of the level and of the one above (`there` tells which cells exist; columns are 0 elsewhere), and returns values and
    `set`, in the target level's box. Only cells in the block are given back, so each once; other levels pass by.
    """
    w, side, names = 1 << level, SIDE << (level + 1), cells.columns
    margin = reach << (level + 1)
    own = [F.floor(F.col(c) / side).cast("int") for c in COORDS]
    span = F.when(F.col("level") == level, w).otherwise(2 * w)
    near = []
    for c, b in zip(COORDS, own, strict=True):
        at = F.pmod(F.col(c), F.lit(side))
        near.append(F.filter(F.array(b, F.when(at < margin, b - 1), F.when(at + span > side - margin, b + 1)), lambda v: v.isNotNull()))
    both = cells.filter(F.col("level").isin(level, level + 1))
    rest = [c for c in cells.columns if c not in (*LEVEL_COORDS, *columns)]
    rows = both.select("*", *[b.alias(f"_h{c}") for b, c in zip(own, COORDS, strict=True)])
    for c, b in zip(COORDS, near, strict=True):
        rows = rows.withColumn(f"_b{c}", F.explode(b))
    home = reduce(lambda a, b: a & b, [F.col(f"_b{c}") == F.col(f"_h{c}") for c in COORDS])
    # What a block only reads of its neighbours travels without the columns that no kernel reads.
    rows = rows.select(*[f"_b{c}" for c in COORDS], home.alias("_home"), *LEVEL_COORDS, *columns, *[F.when(home, F.col(c)).alias(c) for c in rest])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        low = np.array([k.as_py() * side - margin for k in key])
        levels, home = table.column("level").to_numpy(), table.column("_home").to_numpy(zero_copy_only=False)
        place = np.stack([table.column(c).to_numpy() for c in COORDS], axis=1) - low
        widths = {c: len(table.column(c)[0]) for c in columns if pa.types.is_list(table.column(c).type)}
        found: list[tuple[Boxes, tuple[np.ndarray, ...], np.ndarray]] = []
        for k in (0, 1):
            rows = np.flatnonzero(levels == level + k)
            n = (side + 2 * margin) >> (level + k)
            at = tuple(place[rows, a] >> (level + k) for a in (2, 1, 0))
            box = {"there": np.zeros((n, n, n), bool)}
            box["there"][at] = True
            for c in columns:
                data = table.column(c).take(pa.array(rows)).combine_chunks()
                data = data.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), widths[c]) if c in widths else data.to_numpy(zero_copy_only=False)
                box[c] = np.zeros((n, n, n, *data.shape[1:]), data.dtype)
                box[c][at] = data
            found.append((box, at, rows))
        made = kernel(found[0][0], found[1][0])
        _box, at, rows = found[target - level]
        old = table.column(column)
        width = made["value"].shape[-1]
        values = np.zeros((table.num_rows, width))
        known = np.flatnonzero(np.asarray(old.combine_chunks().is_valid()))
        values[known] = old.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        values[rows] = np.where(made["set"][at], made["value"][at], values[rows])
        new = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * width), pa.array(values.ravel()))
        return table.set_column(table.column_names.index(column), column, new).select(names).filter(pa.array(home))

    done = rows.groupBy(*[f"_b{c}" for c in COORDS]).applyInArrow(run, cells.schema)
    return cells.filter(~F.col("level").isin(level, level + 1)).unionByName(done)


def moved(a: np.ndarray, d: Sequence[int]) -> np.ndarray:
    """What lies at an offset (x, y, z) from each place of a box [z, y, x]; nothing beyond its faces."""
    out = np.zeros_like(a)
    to = tuple(slice(max(0, -o), a.shape[k] - max(0, o)) for k, o in enumerate(reversed(d)))
    of = tuple(slice(max(0, o), a.shape[k] - max(0, -o)) for k, o in enumerate(reversed(d)))
    out[to] = a[of]
    return out


def spread(a: np.ndarray) -> np.ndarray:
    """A coarse box at the places of the finer one."""
    for axis in range(3):
        a = np.repeat(a, 2, axis=axis)
    return a


def store_fine(cells: DataFrame, level: int, c: Sequence) -> DataFrame:
    """Adds unrefined cells' populations that a coarse neighbour will pull to the refined coarse cell that it pulls from."""

    def kernel(fine: Boxes, coarse: Boxes) -> Boxes:
        add, got = np.zeros_like(coarse["o"]), np.zeros((*coarse["there"].shape, 1), bool)
        sender, cover = fine["there"] & ~fine["refined"], spread(coarse["there"])
        for q, d in enumerate(c):
            if not any(d):
                continue
            back = tuple(-a for a in d)
            sends = sender & cover & ~moved(fine["there"], d) & moved(spread(coarse["there"] & moved(coarse["there"], back)), d)
            for parity in np.ndindex(2, 2, 2):
                # Of a fine cell with this parity along (x, y, z): the step from its parent to the cell that is sent to.
                step = tuple((i + a) // 2 - a for i, a in zip(parity, d, strict=True))
                pick = tuple(slice(i, None, 2) for i in reversed(parity))
                on = (sends & moved(fine["there"], step))[pick]
                if on.any():
                    home = tuple(-a for a in step)
                    add[..., q] += moved(np.where(on, fine["o"][(*pick, q)], 0.0), home)
                    got[..., 0] |= moved(on, home)
        return {"value": coarse["o"] + add, "set": got}

    return two_levels(cells, level, 2, ["refined", "o"], kernel, level + 1, "o")


def add_at(cells: DataFrame, level: int, sums: DataFrame, n: int, column: str) -> DataFrame:
    wide = sums.groupBy(*[f"s{k}" for k in COORDS]).agg(F.array(*[F.coalesce(F.sum(F.when(F.col("q") == q, F.col("v"))), F.lit(0.0)) for q in range(n)]).alias("_add"))
    joined = cells.join(wide, (F.col("level") == level) & reduce(lambda a, b: a & b, [F.col(k) == F.col(f"s{k}") for k in COORDS]), "left")
    new = F.when(F.col("_add").isNull(), F.col(column)).otherwise(F.zip_with(column, F.coalesce("_add", column), lambda a, b: a + b))
    return joined.withColumn(column, new).select(*cells.columns)


def store_weights(cells: DataFrame, levels: int, c: Sequence) -> DataFrame:
    """Adds weight: 1 / (2 x the number of cells that send to each population of a refined cell), 0 without any."""
    out = cells.withColumn("weight", F.array(*[F.lit(0.0)] * len(c)))
    for level in range(levels - 1):
        rows = senders(cells, level, c)
        counts = rows.groupBy(*[f"s{n}" for n in COORDS], F.col("d.q").alias("q")).agg(F.count(F.lit(1)).cast("double").alias("v"))
        out = add_at(out, level + 1, counts, len(c), "weight")
    return cut(out.withColumn("weight", F.transform("weight", lambda v: F.when(v > 0.001, 1.0 / (2.0 * v)).otherwise(0.0))), "weights")


def store_coarse(cells: DataFrame, level: int, c: Sequence) -> DataFrame:
    """The store begun by the coarse level: the mean, not the sum, of what finer cells would send; nothing without any."""
    rows = senders(cells, level - 1, c)
    means = rows.groupBy(*[f"s{n}" for n in COORDS], F.col("d.q").alias("q")).agg(F.avg(F.element_at("o", F.col("d.q") + 1)).alias("v"))
    return add_at(cells, level, means, len(c), "o")


def stream(cells: DataFrame, level: int, c: Sequence, fine_store: bool = True) -> DataFrame:
    """Streaming, explosion (from coarser cells) and coalescence (from refined ones) of a level's unrefined cells.

    Each population is pulled from the position that it comes from: an unrefined cell of this level (bounced back if that
    isn't bulk), a refined one's gathered share, or else the coarser cell that covers it. What none gives stays.
    """

    def kernel(fine: Boxes, coarse: Boxes) -> Boxes:
        own = fine["there"] & ~fine["refined"]
        bulk = own & (fine["kind"] == BULK)
        cover, o = spread(coarse["there"]), fine["o"]
        value, some = np.zeros_like(o), np.zeros(o.shape, bool)
        for q, d in enumerate(c):
            if not any(d):
                value[..., q], some[..., q] = o[..., q], bulk
                continue
            source, back = tuple(-a for a in d), opposite(c, q)
            there, refined = moved(fine["there"], source), moved(fine["refined"], source)
            flows = moved(fine["kind"] == BULK, source)
            share = moved(fine["weight"][..., q], source) if fine_store else 0.5
            above = own & ~there & cover & moved(cover, source)
            pulled = moved(o[..., q], source)
            v = np.where(refined, pulled * share, np.where(flows, pulled, o[..., back] + moved(o[..., back], source)))
            value[..., q] = np.where(above, moved(spread(coarse["o"][..., q]), source), v)
            some[..., q] = above | (there & ((own & refined) | bulk))
        return {"value": value, "set": some & own[..., None]}

    return two_levels(cells, level, 1, ["refined", "kind", "o", "weight"], kernel, level, "f")


def collide(cells: DataFrame, level: int, levels: int, omega0: float, c: Sequence, w: Sequence[float], kernel=collide_bgk) -> DataFrame:
    """Collision of a level's unrefined bulk cells; refined ones are emptied to gather what finer cells send."""
    here = (F.col("level") == level) & (F.col("kind") == BULK)
    # Other rows collide a fluid at rest instead, so that no empty cell divides by zero.
    rows = cells.withColumn("_g", F.when(here & ~F.col("refined"), F.col("f")).otherwise(F.array(*[F.lit(v) for v in w])))
    rows = kernel(rows.withColumnRenamed("_g", "g"), c, w, omega(omega0, level, levels), "g", "new").drop("g")
    out = F.when(here & ~F.col("refined"), F.col("new")).when(here & F.col("refined") & F.lit(level > 0), F.array(*[F.lit(0.0)] * len(c))).otherwise(F.col("o"))
    return rows.withColumn("o", out).select(*cells.columns)


def advance(cells: DataFrame, level: int, levels: int, omega0: float, c: Sequence, w: Sequence[float], kernel=collide_bgk) -> DataFrame:
    """One step of a level, with two of each finer level; each part is written to the shared folder."""
    for _ in range(1 if level == levels - 1 else 2):
        cells = collide(cells, level, levels, omega0, c, w, kernel)
        if level < levels - 1:
            cells = store_fine(cells, level, c)
        cells = cut(cells, "levels")
        if level:
            cells = advance(cells, level - 1, levels, omega0, c, w, kernel)
        cells = cut(stream(cells, level, c), "levels")
    return cells


def at_rest(cells: DataFrame, dims: Sequence[int], levels: int, c: Sequence, w: Sequence[float], lid: float = 0.0) -> DataFrame:
    """kind, f, o and weight of a closed box: walls are the cells at its faces, the lid the face of largest y."""
    wide = width()
    face = reduce(lambda a, b: a | b, [(F.col(n) == 0) | (F.col(n) + wide >= d) for n, d in zip(COORDS, dims, strict=True)])
    top = F.col("y") + wide >= dims[1]
    kind = F.when(~face, BULK).when(top & F.lit(lid != 0.0), MOVING_WALL).otherwise(BOUNCE_BACK)
    start = [F.when(~face & ~F.col("refined"), t).when(face & top, -6.0 * t * lid * d[0]).otherwise(0.0) for t, d in zip(w, c, strict=True)]
    rows = cells.withColumn("kind", kind).withColumn("f", F.array(*start)).withColumn("o", F.col("f"))
    return store_weights(cut(rows, "levels"), levels, c)


def flow_over(cells: DataFrame, dims: Sequence[int], solid: Column, speed: float, c: Sequence, w: Sequence[float]) -> DataFrame:
    """kind, f and o of a channel: x = 0 is an inlet of some speed along x, faces of y and z and the solid bounce back."""
    wide = width() if "level" in cells.columns else F.lit(1)
    walls = reduce(lambda a, b: a | b, [(F.col(n) == 0) | (F.col(n) + wide >= d) for n, d in list(zip(COORDS, dims, strict=True))[1:]])
    kind = F.when(walls | solid, BOUNCE_BACK).when(F.col("x") == 0, MOVING_WALL).otherwise(BULK)
    rest, inlet, none = (F.array(*map(F.lit, f)) for f in (w, [-6.0 * t * speed * d[0] for t, d in zip(w, c, strict=True)], [0.0] * len(w)))
    start = F.when(F.col("kind") == BULK, rest).when(F.col("kind") == MOVING_WALL, inlet).otherwise(none)
    return cells.withColumn("kind", kind).withColumn("f", start).withColumn("o", F.col("f"))


def centre_line(cells: DataFrame, grid: GridSpec, along: str, value: str, lid: float) -> DataFrame:
    """level, pos and value of the cells of all levels whose origins lie on the middle line, in units of the box and the lid's speed."""
    size = dict(zip(COORDS, (grid.nx, grid.ny, grid.nz), strict=True))
    on = F.lit(True)
    for c in COORDS:
        if c != along:
            on = on & (F.col(c) == size[c] // 2)
    return cells.filter(on).select("level", (F.col(along) / F.lit(float(size[along]))).alias("pos"), (F.col(value) / F.lit(float(lid))).alias("value"))
