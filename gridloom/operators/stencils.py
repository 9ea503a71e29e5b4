"""Neighbourhood operators: every cell sends its values to the cells that read it, and one aggregation gathers them.

The rows that a cell sends carry the number of the neighbour that it is to the reader; the reader itself is slot -1, and
groups without it are cells that don't exist. Sums are combined before the shuffle, so cells that lie together in
a partition exchange little more than its border.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.spec import COORDS, MOORE, S6, GridSpec, Stencil

CENTER = -1


def scatter(field: DataFrame, stencil: Stencil, columns: Sequence[str], keys: Sequence[str] = (), step: Column | int = 1) -> DataFrame:
    """Rows (keys, x, y, z of the reader, slot, columns): one per cell and reader, the cell itself included."""
    offsets = [(CENTER, 0, 0, 0)] + [(k, *o) for k, o in enumerate(stencil)]
    slots = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(o, ("slot", "dx", "dy", "dz"), strict=True)]) for o in offsets])
    rows = field.select(*keys, *COORDS, *columns, F.explode(slots).alias("o"))
    moved = [(F.col(c) - F.col(f"o.d{c}") * step).cast("int").alias(c) for c in COORDS]
    return rows.select(*keys, *moved, F.col("o.slot").alias("slot"), *columns)


def gather(field: DataFrame, stencil: Stencil, columns: Sequence[str], keys: Sequence[str] = (), step: Column | int = 1, carry: Sequence[str] = ()) -> DataFrame:
    """Per cell its own columns, n<k>_<column> for neighbour k, and valid<k>; one shuffle.

    carry: more of the cell's own columns, which its neighbours don't need.
    """
    both = list(dict.fromkeys([*columns, *carry]))
    rows = scatter(field, stencil, both, keys, step)
    at = lambda k, c: F.max(F.when(F.col("slot") == k, F.col(c)))
    own = [at(CENTER, c).alias(c) for c in both]
    values = [at(k, c).alias(f"n{k}_{c}") for k in range(len(stencil)) for c in columns]
    valid = [(F.count(F.when(F.col("slot") == k, 1)) > 0).alias(f"valid{k}") for k in range(len(stencil))]
    there = F.count(F.when(F.col("slot") == CENTER, 1)).alias("_there")
    return rows.groupBy(*keys, *COORDS).agg(*own, *values, *valid, there).filter("_there > 0").drop("_there")


def fold(field: DataFrame, stencil: Stencil, column: str, keys: Sequence[str] = (), step: Column | int = 1, carry: Sequence[str] = (), fn: Callable[[Column], Column] = F.sum) -> DataFrame:
    """Per cell its own columns, total (fn over valid neighbours, null without any) and neighbours, their number."""
    both = list(dict.fromkeys([column, *carry]))
    rows = scatter(field, stencil, both, keys, step)
    center = F.col("slot") == CENTER
    own = [F.max(F.when(center, F.col(c))).alias(c) for c in both]
    out = rows.groupBy(*keys, *COORDS).agg(
        *own, fn(F.when(~center, F.col(column))).alias("total"), F.count(F.when(~center, 1)).alias("neighbours"), F.count(F.when(center, 1)).alias("_there")
    )
    return out.filter("_there > 0").drop("_there")


def neighbour(field: DataFrame, offset: tuple[int, int, int], column: str, alternative: Column | float | None = None) -> DataFrame:
    """value and valid of the cell at one offset; an invalid one reads the alternative."""
    got = gather(field, Stencil((offset,)), [column])
    value = F.col(f"n0_{column}")
    if alternative is not None:
        value = F.when(F.col("valid0"), value).otherwise(alternative if isinstance(alternative, Column) else F.lit(alternative))
    return got.select(*COORDS, column, value.alias("value"), F.col("valid0").alias("valid"))


def neighbour_if(field: DataFrame, offset: tuple[int, int, int], column: str, if_valid: Callable[[Column], Column], if_not: Column) -> DataFrame:
    """The form with two branches: one on the neighbour's value, one where there is none."""
    got = neighbour(field, offset, column)
    return got.withColumn("value", F.when(F.col("valid"), if_valid(F.col("value"))).otherwise(if_not))


def neighbour_by_id(field: DataFrame, stencil: Stencil, number: int, column: str, alternative: Column | float | None = None) -> DataFrame:
    return neighbour(field, stencil.offsets[number], column, alternative)


def neighbour_keys(cells: DataFrame, stencil: Stencil) -> DataFrame:
    """The connectivity table: x, y, z, slot, and the coordinates of each neighbour that exists."""
    rows = scatter(cells, stencil, ["sx", "sy", "sz"]) if "sx" in cells.columns else scatter(
        cells.select(*COORDS, *[F.col(c).alias(f"s{c}") for c in COORDS]), stencil, ["sx", "sy", "sz"]
    )
    sent = rows.filter(F.col("slot") != CENTER)
    return sent.join(cells.select(*COORDS), list(COORDS), "left_semi")


def check_stencil_reads(reads: Iterable[str], writes: Iterable[str]) -> None:
    """A field that a stencil reads may not be written in place."""
    if both := set(reads) & set(writes):
        raise ValueError(f"read through a stencil and written at once: {sorted(both)}")


def laplace_count(field: DataFrame, column: str, stencil: Stencil = S6) -> DataFrame:
    """value - count x sum over valid neighbours."""
    rows = fold(field, stencil, column)
    return rows.select(*COORDS, (F.col(column) - F.col("neighbours") * F.coalesce("total", F.lit(0))).alias("value"))


def laplace_matvec(field: DataFrame, column: str, boundary: str, h: float = 1.0, carry: Sequence[str] = (), out: str = "value") -> DataFrame:
    """(count x center - sum) / h^2 in free cells; fixed cells (boundary = 0) pass their value on."""
    rows = fold(field, S6, column, carry=[boundary, *carry])
    free = (F.col("neighbours") * F.col(column) - F.coalesce("total", F.lit(0))) / F.lit(float(h) * float(h))
    value = F.when(F.col(boundary) == 0, F.col(column).cast("double")).otherwise(free.cast("double"))
    return rows.withColumn(out, value).drop("total", "neighbours")


def laplace_standard(field: DataFrame, column: str) -> DataFrame:
    """6 x center - sum over valid neighbours."""
    rows = fold(field, S6, column)
    return rows.select(*COORDS, (6 * F.col(column) - F.coalesce("total", F.lit(0))).alias("value"))


def laplace_neighbours(field: DataFrame, column: str) -> DataFrame:
    """-6 x sum over valid neighbours; the centre isn't used."""
    return fold(field, S6, column).select(*COORDS, (-6 * F.coalesce("total", F.lit(0))).alias("value"))


def gradient(field: DataFrame, column: str, h: float = 1.0) -> DataFrame:
    """Central differences (up - down) / 2h; the whole vector is 0 where a neighbour is missing."""
    axes = {c: tuple(int(i == k) for i in range(3)) for k, c in enumerate(COORDS)}
    offsets = [o for a in axes.values() for o in (a, tuple(-v for v in a))]
    rows = gather(field, Stencil(tuple(offsets)), [column])
    every = F.col("valid0")
    for k in range(1, 6):
        every = every & F.col(f"valid{k}")
    parts = [(F.col(f"n{2 * k}_{column}") - F.col(f"n{2 * k + 1}_{column}")) / F.lit(2.0 * h) for k in range(3)]
    return rows.select(*COORDS, *[F.when(every, p).otherwise(F.lit(0.0)).alias(f"g{c}") for p, c in zip(parts, COORDS, strict=True)])


def life(field: DataFrame, column: str, shade: int | None = None) -> DataFrame:
    """One generation in every z-plane; shade: multiply by x / shade."""
    ring = MOORE.without_center()
    alive = field.withColumn("_on", (F.col(column) > 0).cast("int"))
    rows = fold(alive, ring, "_on")
    n = F.coalesce("total", F.lit(0))
    lives = ((n == 3) | ((n == 2) & (F.col("_on") > 0))).cast("int")
    return rows.select(*COORDS, (lives if shade is None else lives * F.col("x") / F.lit(float(shade))).alias("value"))


def halo_check(cells: DataFrame, stencil: Stencil) -> DataFrame:
    """Every cell writes its coordinates and reads its neighbours': per cell the valid ones, matches and mismatches."""
    rows = scatter(cells.select(*COORDS, *[F.col(c).alias(f"s{c}") for c in COORDS]), stencil, ["sx", "sy", "sz"])
    offsets = F.create_map(*[v for k, o in enumerate(stencil) for v in (F.lit(k), F.array(*[F.lit(a) for a in o]))])
    o = offsets[F.col("slot")]
    center = F.col("slot") == CENTER
    match = (F.col("sx") == F.col("x") + o[0]) & (F.col("sy") == F.col("y") + o[1]) & (F.col("sz") == F.col("z") + o[2])
    out = rows.groupBy(*COORDS).agg(
        F.count(F.when(~center, 1)).alias("valid"), F.count(F.when(~center & match, 1)).alias("matches"), F.count(F.when(~center & ~match, 1)).alias("mismatches"), F.count(F.when(center, 1)).alias("_there")
    )
    return out.filter("_there > 0").drop("_there")


def neighbour_flags(cells: DataFrame, offset: tuple[int, int, int]) -> DataFrame:
    """1 if the neighbour holds the coordinates that it should, -1 if not, 0 if there is none."""
    own = cells.select(*COORDS, *[F.col(c).alias(f"s{c}") for c in COORDS])
    got = gather(own, Stencil((offset,)), ["sx", "sy", "sz"])
    right = F.lit(True)
    for c, d in zip(COORDS, offset, strict=True):
        right = right & (F.col(f"n0_s{c}") == F.col(c) + d)
    flag = F.when(~F.col("valid0"), 0).when(right, 1).otherwise(-1)
    return got.select(*COORDS, flag.alias("flag"))


def periodic_z(field: DataFrame, grid: GridSpec, column: str) -> DataFrame:
    """in(z-1) + in(z+1) with the box wrapped along z."""
    rows = field.select("x", "y", F.explode(F.array(F.pmod(F.col("z") + 1, F.lit(grid.nz)), F.pmod(F.col("z") - 1, F.lit(grid.nz)))).alias("z"), F.col(column).alias("_v"))
    sums = rows.groupBy(*COORDS).agg(F.sum("_v").alias("value"))
    return sums.join(field.select(*COORDS), list(COORDS), "left_semi")


def open_z(field: DataFrame, column: str, alternative: int = -1) -> DataFrame:
    """in(z-1) + in(z+1), reading the alternative beyond the ends."""
    rows = gather(field, Stencil(((0, 0, -1), (0, 0, 1))), [column])
    read = lambda k: F.when(F.col(f"valid{k}"), F.col(f"n{k}_{column}")).otherwise(F.lit(alternative))
    return rows.select(*COORDS, (read(0) + read(1)).alias("value"))
