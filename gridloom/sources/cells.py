"""Where cells come from: dense, sparse, block and subset grids, geometries, and fields over them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.spec import COORDS, GridSpec

BLOCK = 8


def dense(spark: SparkSession, grid: GridSpec, parts: int | None = None) -> DataFrame:
    """All cells of the box; a dense grid has no activity predicate."""
    keys = spark.range(grid.size) if parts is None else spark.range(0, grid.size, 1, parts)
    return keys.select(*grid.coords(F.col("id")))


def sparse(spark: SparkSession, grid: GridSpec, active: Column, parts: int | None = None) -> DataFrame:
    """The cells for which a predicate on x, y, z holds."""
    return dense(spark, grid, parts).filter(active)


def with_blocks(cells: DataFrame, size: int = BLOCK) -> DataFrame:
    """Block coordinates bx, by, bz and the bit of a cell in its block's mask."""
    block = [F.floor(F.col(c) / size).cast("int").alias(f"b{c}") for c in COORDS]
    bit = (F.col("x") % size + F.col("y") % size * size + F.col("z") % size * size * size).cast("int")
    return cells.select("*", *block, bit.alias("bit"))


def block_masks(cells: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per block that has a cell: how many it has, and its mask as sorted bit numbers."""
    marked = with_blocks(cells, size)
    return marked.groupBy("bx", "by", "bz").agg(F.count(F.lit(1)).alias("active"), F.sort_array(F.collect_set("bit")).alias("mask"))


def subset(outer: DataFrame, points: DataFrame) -> DataFrame:
    """The outer grid's rows at some points; a point without an outer cell is an error, raised when the result is computed."""
    known = outer.withColumn("_known", F.lit(True))
    joined = points.select(*COORDS).distinct().join(known, list(COORDS), "left")
    where = F.concat_ws(",", *COORDS)
    checked = F.when(F.col("_known"), F.col("x")).otherwise(F.raise_error(F.concat(F.lit("point outside the outer grid: "), where)).cast("int"))
    return joined.withColumn("x", checked).drop("_known")


def geometry(name: str, dims: Sequence[int], domain_ratio: float = 1.0, hollow_ratio: float = 0.5) -> Column:
    """Predicates on x, y, z: full, lower_left, cube, hollow_cube, sphere, hollow_sphere.

    The centre is half the dimensions, the radii are half the dimensions times the ratio; the hollow's are those times its own.
    """
    center = [d / 2 for d in dims]
    radii = [d / 2 * domain_ratio for d in dims]
    hollow = [r * hollow_ratio for r in radii]
    axes = [F.col(c).cast("double") for c in COORDS]
    far = [F.abs(a - c) for a, c in zip(axes, center, strict=True)]

    def every(tests: list[Column]) -> Column:
        return tests[0] & tests[1] & tests[2]

    def ball(r: list[float]) -> Column:
        terms = [(a - c) / k * ((a - c) / k) for a, c, k in zip(axes, center, r, strict=True)]
        return terms[0] + terms[1] + terms[2]

    if name == "full":
        return F.lit(True)
    if name == "lower_left":
        return 2 * (axes[0] + axes[1] + axes[2]) <= sum(center)
    if name == "cube":
        return every([d <= r for d, r in zip(far, radii, strict=True)])
    if name == "hollow_cube":
        outside = [d >= r for d, r in zip(far, hollow, strict=True)]
        return every([d <= r for d, r in zip(far, radii, strict=True)]) & (outside[0] | outside[1] | outside[2])
    if name == "sphere":
        return ball(radii) <= 1.0
    if name == "hollow_sphere":
        return (ball(radii) <= 1.0) & (ball(hollow) >= 1.0)
    raise ValueError(f"unknown geometry: {name}")


def new_field(cells: DataFrame, value: Column | float, cardinality: int = 1, name: str = "c", dtype: str = "double") -> DataFrame:
    """A field of `cardinality` components name0, name1, ... with one value in every cell."""
    if cardinality < 1:
        raise ValueError("a field has at least one component")
    value = value if isinstance(value, Column) else F.lit(value)
    return cells.select("*", *[value.cast(dtype).alias(f"{name}{i}") for i in range(cardinality)])


def for_each_active(cells: DataFrame, fn: Callable[[Column, Column, Column, int], Column], cardinality: int = 1, name: str = "c") -> DataFrame:
    """Sets each component by fn(x, y, z, component) in every active cell."""
    x, y, z = map(F.col, COORDS)
    return cells.withColumns({f"{name}{i}": fn(x, y, z, i) for i in range(cardinality)})


def for_each_cell(spark: SparkSession, grid: GridSpec, field: DataFrame, outside: dict[str, float]) -> DataFrame:
    """The whole box: inactive cells read the outside values; `active` tells them apart."""
    joined = dense(spark, grid).join(field.withColumn("active", F.lit(True)), list(COORDS), "left")
    values = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in outside.items()}
    return joined.withColumns(values | {"active": F.coalesce("active", F.lit(False))})


def linear(grid: GridSpec, component: int = 0, offset: int = 0) -> Column:
    """offset + linear index + component x box size."""
    return grid.pitch() + F.lit(offset + component * (grid.size if component else 0))


def masked(component: int = 0, offset: int = 0, digit: int = 2) -> Column:
    """A number whose digit groups are z, y, x, component and offset."""
    m = 10**digit
    x, y, z = (F.col(c).cast("long") for c in COORDS)
    return z + y * m + x * m**2 + F.lit(component * m**3 + offset * m**3 * 10).cast("long")


def seeded(low: int, high: int, seed: int = 0) -> Column:
    """Whole numbers from low to high that depend on the cell and the seed alone."""
    return (F.lit(low) + F.pmod(F.xxhash64(*COORDS, F.lit(seed)), F.lit(high - low + 1))).cast("long")


def to_dense(spark: SparkSession, grid: GridSpec, field: DataFrame, columns: Sequence[str], outside: float = 0.0) -> np.ndarray:
    """A field as a NumPy array [component, z, y, x]; for boxes that fit the driver."""
    out = np.full((len(columns), grid.nz, grid.ny, grid.nx), outside)
    table = field.select(*COORDS, *columns).toArrow()
    x, y, z = (table.column(k).to_numpy() for k in range(3))
    for i in range(len(columns)):
        out[i, z, y, x] = table.column(3 + i).to_numpy()
    return out


def from_dense(spark: SparkSession, cells: DataFrame, values: np.ndarray, name: str = "c") -> DataFrame:
    """Active cells take an array's [component, z, y, x] values; others don't exist."""
    n, nz, ny, nx = values.shape
    grid = GridSpec(nx, ny, nz)
    flat = values.reshape(n, -1).astype(float)
    frame = spark.createDataFrame(pa.table({"k": np.arange(flat.shape[1])} | {f"{name}{i}": flat[i] for i in range(n)}))
    outside = cells.filter(~grid.inside(*map(F.col, COORDS))).limit(1).count()
    if outside:
        raise ValueError("the array is smaller than the grid")
    return cells.join(frame.select(*grid.coords(F.col("k")), *[f"{name}{i}" for i in range(n)]), list(COORDS))


def max_diff(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: the largest absolute difference of a column and the first cell that has it."""
    joined = a.select(*COORDS, F.col(column).alias("_a")).join(b.select(*COORDS, F.col(column).alias("_b")), list(COORDS), "full")
    diff = joined.select(*COORDS, F.abs(F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0))).alias("d"))
    return diff.agg(F.max(F.struct("d", -F.col("z"), -F.col("y"), -F.col("x"))).alias("m")).select(
        F.col("m.d").alias("max_diff"), (-F.col("m.col4")).alias("x"), (-F.col("m.col3")).alias("y"), (-F.col("m.col2")).alias("z")
    )


def signed_distance(shape: str, center: Sequence[float], size: float | Sequence[float]) -> Column:
    """Distance to a sphere (radius) or an axis-aligned box (half widths); negative inside."""
    d = [F.col(c).cast("double") - float(m) for c, m in zip(COORDS, center, strict=True)]
    if shape == "sphere":
        return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) - float(size)
    if shape == "box":
        q = [F.abs(a) - float(h) for a, h in zip(d, size, strict=True)]
        out = [F.greatest(a, F.lit(0.0)) for a in q]
        return F.sqrt(out[0] * out[0] + out[1] * out[1] + out[2] * out[2]) + F.least(F.greatest(*q), F.lit(0.0))
    raise ValueError(f"unknown shape: {shape}")
