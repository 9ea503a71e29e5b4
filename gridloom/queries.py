"""The registered grid queries, each with the SQL that must agree with it.

Grids are views of the driver's tables: orders is a box of 25 x 25 cells per plane (x fastest), with whole-number values v
(the price in cents) and w (the customer); part is one of 16 x 16 with a ragged last plane.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import vectors as V
from gridloom.lbm import boundaries, uniform, verify
from gridloom.lbm import multires as level_flow
from gridloom.lbm.lattice import C19, C27, OPPOSITE_19, OPPOSITE_27, W19, W27, Cavity
from gridloom.operators import halo, maps, multires, partitions, reductions, staggered, stencils, subsets
from gridloom.solver import cg
from gridloom.sources import cells as source
from gridloom.sources import sinks
from gridloom.spec import COORDS, MOORE, S6, S7, S19, S27, GridSpec, Stencil

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Cells with populations in a task, about, and along the side of a block that stays together.
SHARE, SHARE_SIDE = 50_000, 16
BOX = GridSpec(25, 25)
RAGGED = GridSpec(16, 16)


def register(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    v, w = F.round(F.col("o_totalprice") * 100).cast("long"), F.col("o_custkey").cast("long")
    return rows.select(*BOX.coords(F.col("o_orderkey")), v.alias("v"), w.alias("w"))


def tower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders on planes of 5 x 5 cells."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    v, w = F.round(F.col("o_totalprice") * 100).cast("long"), F.col("o_custkey").cast("long")
    return rows.select(*GridSpec(5, 5).coords(F.col("o_orderkey")), v.alias("v"), w.alias("w"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.select(*RAGGED.coords(F.col("p_partkey")), F.col("p_size").cast("long").alias("v"))


def height(field: DataFrame) -> int:
    return field.agg(F.coalesce(F.max("z"), F.lit(-1))).first()[0] + 1


G = """g AS (SELECT CAST(o_orderkey % 25 AS INTEGER) AS x, CAST(o_orderkey // 25 % 25 AS INTEGER) AS y, CAST(o_orderkey // 625 AS INTEGER) AS z,
 CAST(round(o_totalprice * 100) AS BIGINT) AS v, CAST(o_custkey AS BIGINT) AS w FROM orders)"""
SPARSE = f"{G}, s AS (SELECT * FROM g WHERE v % 3 <> 0)"
TALL = G.replace("% 25", "% 5").replace("// 25", "// 5").replace("// 625", "// 25")
PART = """p AS (SELECT CAST(p_partkey % 16 AS INTEGER) AS x, CAST(p_partkey // 16 % 16 AS INTEGER) AS y, CAST(p_partkey // 256 AS INTEGER) AS z, CAST(p_size AS BIGINT) AS v FROM part)"""


def values(stencil: Stencil) -> str:
    rows = ", ".join(f"({k}, {a}, {b}, {c})" for k, (a, b, c) in enumerate(stencil))
    return f"off(slot, dx, dy, dz) AS (VALUES {rows})"


def around(stencil: Stencil, cells: str, own: str = "c.v", read: str = "n.v") -> str:
    """CTEs off and nb: one row per cell and neighbour number, nv null and ok false where there is none."""
    return f"""{values(stencil)}, nb AS (SELECT c.x, c.y, c.z, {own}, o.slot, o.dx, o.dy, o.dz, {read} AS nv, n.x IS NOT NULL AS ok
 FROM {cells} c CROSS JOIN off o LEFT JOIN {cells} n ON n.x = c.x + o.dx AND n.y = c.y + o.dy AND n.z = c.z + o.dz)"""


def folded(cells: str, stencil: Stencil, value: str) -> str:
    """A query of value, over v, t (sum of valid neighbours) and n (their number)."""
    return f"""SELECT x, y, z, {value} AS value FROM (SELECT x, y, z, any_value(v) AS v, CAST(coalesce(sum(nv), 0) AS BIGINT) AS t, CAST(count(nv) AS BIGINT) AS n FROM nb GROUP BY x, y, z)"""


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).filter("v % 3 <> 0")


# Sources and initialisers.

CELLS = "SELECT CAST(i % {0} AS INTEGER) AS x, CAST(i // {0} % {1} AS INTEGER) AS y, CAST(i // {2} AS INTEGER) AS z FROM range({3}) t(i)"


@register("g001_dense_grid", CELLS.format(10, 17, 170, 2210))
def _(spark, sf_dir):
    return source.dense(spark, GridSpec(10, 17, 13))


@register("g002_sparse_grid", f"WITH {SPARSE} SELECT x, y, z FROM s")
def _(spark, sf_dir):
    return sparse(spark, sf_dir).select(*COORDS)


@register("g003_block_grid", f"""WITH {SPARSE}, b AS (SELECT x // 8 AS bx, y // 8 AS "by", z // 8 AS bz, x % 8 + y % 8 * 8 + z % 8 * 64 AS bit FROM s)
SELECT CAST(bx AS INTEGER) AS bx, CAST("by" AS INTEGER) AS "by", CAST(bz AS INTEGER) AS bz, count(*) AS active, CAST(sum(bit) AS BIGINT) AS bits FROM b GROUP BY bx, "by", bz""")
def _(spark, sf_dir):
    masks = source.block_masks(sparse(spark, sf_dir))
    return masks.select("bx", "by", "bz", "active", F.aggregate("mask", F.lit(0).cast("long"), lambda a, b: a + b).alias("bits"))


@register("g005_subset_grid", f"WITH {G}, {PART} SELECT g.x, g.y, g.z, g.v FROM g JOIN p USING (x, y, z)")
def _(spark, sf_dir):
    return source.subset(orders(spark, sf_dir), parts(spark, sf_dir)).select(*COORDS, "v")


SHAPES = ("full", "lower_left", "cube", "hollow_cube", "sphere", "hollow_sphere")
_IN = {
    "full": "true", "lower_left": "2 * (x + y + z) <= 30", "cube": "abs(x - 10.0) <= 8 AND abs(y - 10.0) <= 8 AND abs(z - 10.0) <= 8",
    "hollow_cube": "abs(x - 10.0) <= 8 AND abs(y - 10.0) <= 8 AND abs(z - 10.0) <= 8 AND (abs(x - 10.0) >= 4 OR abs(y - 10.0) >= 4 OR abs(z - 10.0) >= 4)",
    "sphere": "(x - 10) * (x - 10) + (y - 10) * (y - 10) + (z - 10) * (z - 10) <= 64",
    "hollow_sphere": "(x - 10) * (x - 10) + (y - 10) * (y - 10) + (z - 10) * (z - 10) BETWEEN 16 AND 64",
}


@register("g006_geometries", f"WITH c AS ({CELLS.format(20, 20, 400, 8000)}) " + " UNION ALL ".join(f"SELECT '{k}' AS shape, x, y, z FROM c WHERE {_IN[k]}" for k in SHAPES))
def _(spark, sf_dir):
    grid = GridSpec(20, 20, 20)
    shapes = [source.sparse(spark, grid, source.geometry(s, (20, 20, 20), 0.8, 0.5)).select(F.lit(s).alias("shape"), *COORDS) for s in SHAPES]
    return reduce(DataFrame.unionByName, shapes)


@register("g007_new_field", f"WITH {SPARSE} SELECT x, y, z, 7.5::DOUBLE AS c0, 7.5::DOUBLE AS c1 FROM s")
def _(spark, sf_dir):
    return source.new_field(sparse(spark, sf_dir).select(*COORDS), 7.5, 2)


@register("g008_for_each_active", f"WITH {SPARSE} SELECT x, y, z, x + 10 * y + 100 * z AS c0, x + 10 * y + 100 * z + 1000 AS c1 FROM s")
def _(spark, sf_dir):
    return source.for_each_active(sparse(spark, sf_dir).select(*COORDS), lambda x, y, z, i: x + 10 * y + 100 * z + 1000 * i, 2)


@register("g009_for_each_cell", f"WITH {SPARSE}, c AS (SELECT CAST(i % 25 AS INTEGER) AS x, CAST(i // 25 % 25 AS INTEGER) AS y, CAST(i // 625 AS INTEGER) AS z FROM range((SELECT 625 * (max(z) + 1) FROM s)) t(i)) SELECT c.x, c.y, c.z, coalesce(s.v, -1) AS v, s.x IS NOT NULL AS active FROM c LEFT JOIN s USING (x, y, z)")
def _(spark, sf_dir):
    field = sparse(spark, sf_dir).select(*COORDS, "v")
    return source.for_each_cell(spark, GridSpec(25, 25, height(field)), field, {"v": -1})


@register("g011_field_makers", f"WITH {G} SELECT x, y, z, CAST(5 + x + y * 25 + z * 625 AS BIGINT) AS linear, CAST(z + y * 100 + x * 10000 + 3000000 AS BIGINT) AS masked, 10 AS const FROM g")
def _(spark, sf_dir):
    return orders(spark, sf_dir).select(*COORDS, source.linear(BOX, 0, 5).alias("linear"), source.masked(3).alias("masked"), F.lit(10).alias("const"))


@register("g012_max_diff", f"WITH {G}, d AS (SELECT abs(v - w) AS d, x, y, z FROM g) SELECT d AS max_diff, x, y, z FROM d ORDER BY d DESC, z, y, x LIMIT 1")
def _(spark, sf_dir):
    g = orders(spark, sf_dir)
    return source.max_diff(g.select(*COORDS, "v"), g.select(*COORDS, F.col("w").alias("v")), "v")


# Maps.


def map_query(name: str, columns: dict[str, str], make: Callable[[DataFrame], DataFrame]) -> None:
    """A projection of the orders grid: SQL expressions against what make returns."""
    chosen = ", ".join(f"{e} AS {c}" for c, e in columns.items())

    @register(name, f"WITH {G} SELECT x, y, z, {chosen} FROM g")
    def _(spark, sf_dir):
        return make(orders(spark, sf_dir)).select(*COORDS, *columns)


map_query("g021_map", {"v": "v + x * y - z"}, lambda g: g.withColumn("v", F.col("v") + F.col("x") * F.col("y") - F.col("z")))
map_query("g022_set", {"v": "33", "w": "33"}, lambda g: maps.apply(g, maps.fill(["v", "w"], 33)))
map_query("g023_copy", {"w": "v"}, lambda g: maps.apply(g, maps.copy("v", "w")))
map_query("g024_axpy", {"w": "w + 33 * v"}, lambda g: maps.apply(g, maps.axpy(33, "v", "w")))
map_query("g025_xpy", {"w": "w + v"}, lambda g: maps.apply(g, maps.xpy("v", "w")))
map_query("g026_ainv_xpy", {"w": "w::DOUBLE + 0.25::DOUBLE * v"}, lambda g: maps.apply(g, maps.ainv_xpy(4.0, "v", "w")))
map_query("g027_init_residual", {"r": "CASE WHEN v % 2 = 1 THEN w ELSE v END"}, lambda g: maps.apply(g.withColumn("bd", F.col("v") % 2), maps.init_residual("bd", "w", "v", "r")))
map_query("g028_subtract", {"v": "v - w"}, lambda g: maps.apply(g, maps.subtract("v", "w")))
map_query("g029_update_x_and_r", {"v": "v + 0.5::DOUBLE * w", "w": "w - 0.5::DOUBLE * v"}, lambda g: maps.apply(g.withColumns({"p": F.col("w"), "s": F.col("v")}), maps.update_x_and_r(F.lit(2.0), F.lit(4.0), "v", "w", "p", "s")))
map_query("g030_update_p", {"w": "v + 1.5::DOUBLE * w"}, lambda g: maps.apply(g, maps.update_p(F.lit(6.0), F.lit(4.0), "v", "w")))
map_query("g031_level_set", {"v": "v - 17"}, lambda g: maps.apply(g, maps.expand_level_set("v", 17)))
map_query("g032_global_index", {"k": "CAST(x + 25 * y + 625 * z AS BIGINT)"}, lambda g: g.withColumn("k", BOX.pitch()))
map_query("g033_mixed_precision", {"h": "CAST(v AS FLOAT)", "d": "CAST(CAST(v AS FLOAT) AS DOUBLE) * 2"}, lambda g: g.withColumn("h", maps.cast_read("v", "float")).withColumn("d", F.col("h").cast("double") * 2))
map_query("g034_guarded", {"v": "CASE WHEN w % 5 = 0 THEN v * 2 ELSE v END"}, lambda g: maps.apply(g, maps.guarded(F.col("w") % 5 == 0, {"v": F.col("v") * 2})))
map_query("g037_swap", {"v": "w", "w": "v"}, lambda g: maps.swap(g, "v", "w"))
map_query("g038_replica", {"v": "v * (3 + x % 2)"}, lambda g: g.withColumn("v", F.col("v") * F.element_at(F.array(F.lit(3), F.lit(4)), (F.col("x") % 2 + 1).cast("int"))))
map_query("g039_signed_distance", {"ball": "round(sqrt((x - 12.0) * (x - 12.0) + (y - 12.0) * (y - 12.0) + (z - 12.0) * (z - 12.0)) - 5, 6)", "box": "round(sqrt(greatest(abs(x - 12.0) - 4, 0) ** 2 + greatest(abs(y - 12.0) - 3, 0) ** 2 + greatest(abs(z - 12.0) - 2, 0) ** 2) + least(greatest(abs(x - 12.0) - 4, abs(y - 12.0) - 3, abs(z - 12.0) - 2), 0), 6)"},
          lambda g: g.withColumn("ball", F.round(source.signed_distance("sphere", (12, 12, 12), 5), 6)).withColumn("box", F.round(source.signed_distance("box", (12, 12, 12), (4, 3, 2)), 6)))
map_query("g135_add", {"u": "v + w"}, lambda g: maps.apply(g, maps.add("v", "w", "u")))
map_query("g136_xpypz", {"u": "x + v + w"}, lambda g: maps.apply(g.withColumn("u", F.col("x").cast("long")), maps.xpypz("v", "w", "u")))
map_query("g137_scaled_copy", {"u": "7 * v"}, lambda g: maps.apply(g, maps.scale(7, "v", "u")))


_JULIA = f"""WITH RECURSIVE c AS ({CELLS.format(64, 32, 2048, 2048)}), j AS (
 SELECT x, y, z, 0 AS k, 0 AS n, 2::DOUBLE * (x / 32::DOUBLE - 1::DOUBLE) AS a, 2::DOUBLE * (y / 32::DOUBLE - 0.5::DOUBLE) AS b FROM c
 UNION ALL SELECT x, y, z, k + 1, n + CASE WHEN sqrt(a * a + b * b) < 20 THEN 1 ELSE 0 END,
  CASE WHEN sqrt(a * a + b * b) < 20 THEN a * a - b * b + (-0.8)::DOUBLE ELSE a END, CASE WHEN sqrt(a * a + b * b) < 20 THEN 2::DOUBLE * a * b + {0.2 * math.cos(0.3)!r}::DOUBLE ELSE b END FROM j WHERE k < 50)
SELECT x, y, z, round(1::DOUBLE - 0.02::DOUBLE * n, 6) AS shade FROM j WHERE k = 50"""


@register("g035_julia", _JULIA)
def _(spark, sf_dir):
    return source.dense(spark, GridSpec(64, 32, 1)).select(*COORDS, F.round(maps.julia(32, 10.0), 6).alias("shade"))


@register("g036_host_map", f"WITH {G} SELECT x, y, z, v % 7 AS v FROM g")
def _(spark, sf_dir):
    from gridloom.plans.pipeline import on_pandas

    return on_pandas(lambda p: p.assign(v=p["v"] % 7), "x int, y int, z int, v long")(orders(spark, sf_dir).select(*COORDS, "v"))


# Neighbours.


@register("g040_neighbour", f"WITH {SPARSE}, {around(Stencil(((1, 0, 0),)), 's')} SELECT x, y, z, v, nv AS value, ok AS valid FROM nb")
def _(spark, sf_dir):
    return stencils.neighbour(sparse(spark, sf_dir), (1, 0, 0), "v")


@register("g041_neighbour_or", f"WITH {SPARSE}, {around(Stencil(((0, -1, 0),)), 's')} SELECT x, y, z, v, coalesce(nv, -5) AS value, ok AS valid FROM nb")
def _(spark, sf_dir):
    return stencils.neighbour(sparse(spark, sf_dir), (0, -1, 0), "v", -5)


@register("g042_neighbour_branches", f"WITH {SPARSE}, {around(Stencil(((0, 0, 1),)), 's')} SELECT x, y, z, v, CASE WHEN ok THEN nv * 2 ELSE 11 END AS value, ok AS valid FROM nb")
def _(spark, sf_dir):
    return stencils.neighbour_if(sparse(spark, sf_dir), (0, 0, 1), "v", lambda n: n * 2, F.lit(11))


@register("g044_neighbour_by_id", f"WITH {SPARSE}, {around(Stencil((S19.offsets[7],)), 's')} SELECT x, y, z, v, coalesce(nv, 0) AS value, ok AS valid FROM nb")
def _(spark, sf_dir):
    return stencils.neighbour_by_id(sparse(spark, sf_dir), S19, 7, "v", 0)


@register("g045_neighbour_keys", f"WITH {SPARSE}, {around(S6, 's')} SELECT x, y, z, slot, CAST(x + dx AS INTEGER) AS sx, CAST(y + dy AS INTEGER) AS sy, CAST(z + dz AS INTEGER) AS sz FROM nb WHERE ok")
def _(spark, sf_dir):
    return stencils.neighbour_keys(sparse(spark, sf_dir).select(*COORDS), S6)


@register("g047_stencils", " UNION ALL ".join(f"SELECT '{n}' AS stencil, * FROM (VALUES {', '.join(f'({k}, {a}, {b}, {c})' for k, (a, b, c) in enumerate(s))}) t(slot, dx, dy, dz)" for n, s in (("s6", S6), ("s7", S7), ("s19", S19), ("s27", S27))))
def _(spark, sf_dir):
    rows = [(n, k, *o) for n, s in (("s6", S6), ("s7", S7), ("s19", S19), ("s27", S27)) for k, o in enumerate(s)]
    return spark.createDataFrame(rows, "stencil string, slot int, dx int, dy int, dz int")


@register("g049_laplace_count", f"WITH {G}, {around(S6, 'g')} {folded('g', S6, 'v - n * t')}")
def laplace_count(spark, sf_dir):
    return stencils.laplace_count(orders(spark, sf_dir), "v")


@register("g049_laplace_count_sparse", f"WITH {SPARSE}, {around(S6, 's')} {folded('s', S6, 'v - n * t')}")
def _(spark, sf_dir):
    return stencils.laplace_count(sparse(spark, sf_dir), "v")


@register("g049_laplace_count_ragged", f"WITH {PART}, {around(S6, 'p')} {folded('p', S6, 'v - n * t')}")
def _(spark, sf_dir):
    return stencils.laplace_count(parts(spark, sf_dir), "v")


@register("g049_laplace_count_blocks", f"WITH {SPARSE}, {around(S6, 's')} {folded('s', S6, 'v - n * t')}")
def _(spark, sf_dir):
    return halo.laplace_count(sparse(spark, sf_dir), "v", 8)


@register("g050_laplace_matvec", f"WITH {G}, {around(S6, 'g', 'c.v, c.w')} SELECT x, y, z, CASE WHEN b = 0 THEN v::DOUBLE ELSE (n * v - t)::DOUBLE / 0.25 END AS value FROM (SELECT x, y, z, any_value(v) AS v, any_value(w) % 4 AS b, CAST(coalesce(sum(nv), 0) AS BIGINT) AS t, count(nv) AS n FROM nb GROUP BY x, y, z)")
def _(spark, sf_dir):
    g = orders(spark, sf_dir).withColumn("bd", F.col("w") % 4)
    return stencils.laplace_matvec(g, "v", "bd", 0.5).select(*COORDS, "value")


_AXES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


@register("g051_gradient", f"WITH {SPARSE}, {around(Stencil(tuple(_AXES)), 's')} SELECT x, y, z, " + ", ".join(f"CASE WHEN count(nv) = 6 THEN (max(nv) FILTER (slot = {2 * k}) - max(nv) FILTER (slot = {2 * k + 1}))::DOUBLE / 2 ELSE 0 END AS g{c}" for k, c in enumerate(COORDS)) + " FROM nb GROUP BY x, y, z")
def _(spark, sf_dir):
    return stencils.gradient(sparse(spark, sf_dir), "v", 1.0)


_RING = Stencil(tuple(o for o in S27 if o[2] == 0 and o != (0, 0, 0)))


@register("g052_life", f"WITH {G}, l AS (SELECT x, y, z, CASE WHEN v % 3 = 0 THEN 1 ELSE 0 END AS v FROM g), {around(_RING, 'l')} {folded('l', _RING, 'CASE WHEN t = 3 OR (t = 2 AND v > 0) THEN 1 ELSE 0 END')}")
def _(spark, sf_dir):
    g = orders(spark, sf_dir).withColumn("v", (F.col("v") % 3 == 0).cast("int"))
    return stencils.life(g, "v")


@register("g054_voxel_sums", f"WITH {PART}, n AS (SELECT DISTINCT x + a AS x, y + b AS y, z + c AS z FROM p, range(2) i(a), range(2) j(b), range(2) k(c)) SELECT p.x, p.y, p.z, CAST(sum(n.x + 100 * n.y + 10000 * n.z) AS BIGINT) AS value FROM p JOIN n ON n.x - p.x BETWEEN 0 AND 1 AND n.y - p.y BETWEEN 0 AND 1 AND n.z - p.z BETWEEN 0 AND 1 GROUP BY p.x, p.y, p.z")
def _(spark, sf_dir):
    p = parts(spark, sf_dir)
    nodes = staggered.nodes_of(p).withColumn("c", (F.col("x") + 100 * F.col("y") + 10000 * F.col("z")).cast("long"))
    return staggered.voxel_sums(nodes, p, "c")


@register("g055_node_means", f"WITH {PART} SELECT CAST(x + a AS INTEGER) AS x, CAST(y + b AS INTEGER) AS y, CAST(z + c AS INTEGER) AS z, sum(v) / 8.0::DOUBLE AS value FROM p, range(2) i(a), range(2) j(b), range(2) k(c) GROUP BY ALL")
def _(spark, sf_dir):
    return staggered.node_means(parts(spark, sf_dir), "v")


@register("g056_voxel_of_node", f"WITH {PART}, n AS (SELECT DISTINCT CAST(x + a AS INTEGER) AS x, CAST(y + b AS INTEGER) AS y, CAST(z + c AS INTEGER) AS z FROM p, range(2) i(a), range(2) j(b), range(2) k(c)) SELECT n.x, n.y, n.z, coalesce(p.v, -3) AS value, p.x IS NOT NULL AS valid FROM n LEFT JOIN p ON p.x = n.x - 1 AND p.y = n.y AND p.z = n.z - 1")
def _(spark, sf_dir):
    p = parts(spark, sf_dir)
    return staggered.voxel_of_node(staggered.nodes_of(p), p, (-1, 1, -1), "v", -3)


_QUARTERS = "n AS (SELECT max(z) + 1 AS nz FROM g), b AS (SELECT CAST(k AS INTEGER) AS slab, k * (nz // 4) + least(k, nz % 4) AS low, (k + 1) * (nz // 4) + least(k + 1, nz % 4) AS high FROM n, range(4) t(k))"


@register("g057_halo_update", f"WITH {TALL}, {_QUARTERS} SELECT slab, x, y, z, v, NOT z BETWEEN low AND high - 1 AS ghost FROM g JOIN b ON z >= low - 2 AND z < high + 2")
def _(spark, sf_dir):
    field = tower(spark, sf_dir).select(*COORDS, "v")
    return partitions.halo_update(field, partitions.slab_bounds(height(field), 4), 2)


@register("g058_periodic_z", f"WITH {G}, h AS (SELECT max(z) + 1 AS n FROM g) SELECT c.x, c.y, c.z, CAST(sum(g.v) AS BIGINT) AS value FROM g c, h JOIN g ON g.x = c.x AND g.y = c.y AND (g.z = (c.z + 1) % h.n OR g.z = (c.z + h.n - 1) % h.n) GROUP BY c.x, c.y, c.z".replace("FROM g c, h JOIN g ON", "FROM g c CROSS JOIN h JOIN g ON"))
def _(spark, sf_dir):
    g = orders(spark, sf_dir)
    return stencils.periodic_z(g, GridSpec(25, 25, height(g)), "v")


@register("g139_laplace_standard", f"WITH {SPARSE}, {around(S6, 's')} {folded('s', S6, '6 * v - t')}")
def _(spark, sf_dir):
    return stencils.laplace_standard(sparse(spark, sf_dir), "v")


@register("g140_laplace_neighbours", f"WITH {SPARSE}, {around(S6, 's')} {folded('s', S6, '-6 * t')}")
def _(spark, sf_dir):
    return stencils.laplace_neighbours(sparse(spark, sf_dir), "v")


_ROUND = "p{1} AS MATERIALIZED (SELECT x, y, z, CAST((any_value(v) - count(nv) * coalesce(sum(nv), 0)) % 1000 AS BIGINT) AS v FROM (SELECT c.x, c.y, c.z, c.v, n.v AS nv FROM p{0} c CROSS JOIN off o LEFT JOIN p{0} n ON n.x = c.x + o.dx AND n.y = c.y + o.dy AND n.z = c.z + o.dz) GROUP BY x, y, z)"


@register("g141_laplace_iterated", f"WITH {PART}, {values(S6)}, p0 AS (SELECT * FROM p), {', '.join(_ROUND.format(k, k + 1) for k in range(5))} SELECT x, y, z, v FROM p5")
def _(spark, sf_dir):
    """Five rounds with two fields in turn; numbers are kept small by a remainder."""
    g = parts(spark, sf_dir)
    for _k in range(5):
        g = stencils.laplace_count(g, "v").select(*COORDS, (F.col("value") % 1000).alias("v"))
    return g


@register("g142_halo_check", f"WITH {SPARSE}, {around(S19.without_center(), 's')} SELECT x, y, z, count(nv) AS valid, count(nv) AS matches, 0::BIGINT AS mismatches FROM nb GROUP BY x, y, z")
def _(spark, sf_dir):
    return stencils.halo_check(sparse(spark, sf_dir), S19.without_center())


@register("g143_neighbour_flags", f"WITH {SPARSE}, {around(Stencil(((1, 1, 0),)), 's')} SELECT x, y, z, CASE WHEN ok THEN 1 ELSE 0 END AS flag FROM nb")
def _(spark, sf_dir):
    return stencils.neighbour_flags(sparse(spark, sf_dir), (1, 1, 0))


@register("g149_open_z", f"WITH {G}, {around(Stencil(((0, 0, -1), (0, 0, 1))), 'g')} SELECT x, y, z, CAST(sum(coalesce(nv, -1)) AS BIGINT) AS value FROM nb GROUP BY x, y, z")
def _(spark, sf_dir):
    return stencils.open_z(orders(spark, sf_dir), "v", -1)


# Reductions.


@register("g059_dot", f"WITH {G} SELECT CAST(sum(v * w) AS BIGINT) AS dot FROM g")
def _(spark, sf_dir):
    return reductions.narrowed(reductions.dot(orders(spark, sf_dir), "v", "w"), "dot")


@register("g060_norm2", f"WITH {PART} SELECT sqrt(CAST(sum(v * v) AS DOUBLE)) AS norm2 FROM p")
def _(spark, sf_dir):
    return reductions.norm2(parts(spark, sf_dir), "v")


@register("g061_absolute_sum", f"WITH {G} SELECT CAST(sum(abs(v - 10000000)) AS BIGINT) AS abs_sum FROM g")
def _(spark, sf_dir):
    return reductions.narrowed(reductions.absolute_sum(orders(spark, sf_dir).withColumn("v", F.col("v") - 10000000), "v"), "abs_sum")


@register("g062_range_dot", f"WITH {G} SELECT CAST(sum(v * w) AS BIGINT) AS dot FROM g WHERE x + 25 * y + 625 * z BETWEEN 100 AND 1099")
def _(spark, sf_dir):
    return reductions.narrowed(reductions.dot(reductions.in_range(orders(spark, sf_dir), BOX, 100, 1000), "v", "w"), "dot")


_VIEW = "CASE WHEN (k > 0 AND z < lo + 1) OR (k < 2 AND z >= hi - 1) THEN 'BOUNDARY' ELSE 'INTERNAL' END"
_SLABS = f"{TALL}, h AS (SELECT max(z) + 1 AS n FROM g), b AS (SELECT k, k * (n // 3) + least(k, n % 3) AS lo, (k + 1) * (n // 3) + least(k + 1, n % 3) AS hi FROM h, range(3) t(k)), q AS (SELECT g.*, CAST(k AS INTEGER) AS slab, lo, hi, k FROM g JOIN b ON z >= lo AND z < hi)"


@register("g066_dot_by_view", f"WITH {_SLABS}, e AS (SELECT {_VIEW} AS data_view, v * w AS t FROM q) SELECT data_view, CAST(sum(t) AS BIGINT) AS total FROM e GROUP BY data_view UNION ALL SELECT 'STANDARD', CAST(sum(t) AS BIGINT) FROM e")
def _(spark, sf_dir):
    g = tower(spark, sf_dir)
    viewed = g.withColumn("data_view", partitions.data_view(partitions.slab_bounds(height(g), 3)))
    return reductions.narrowed(reductions.by_view(viewed, F.col("v") * F.col("w")), "total")


@register("g069_active_cells", f"WITH {SPARSE} SELECT z, count(*) AS cells FROM s GROUP BY z")
def _(spark, sf_dir):
    return reductions.counts(sparse(spark, sf_dir), "z")


@register("g070_scatter_add", f"WITH {G} SELECT CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y, CAST(z // 2 AS INTEGER) AS z, CAST(sum(v) AS BIGINT) AS total FROM g GROUP BY x // 2, y // 2, z // 2")
def _(spark, sf_dir):
    rows = orders(spark, sf_dir).select(*[F.floor(F.col(c) / 2).cast("int").alias(c) for c in COORDS], "v")
    return reductions.scatter_add(rows, list(COORDS), "v")


@register("g071_relative_error", f"WITH {G} SELECT max(abs(v - w)::DOUBLE / abs(w)) AS relative_error FROM g WHERE w <> 0")
def _(spark, sf_dir):
    g = orders(spark, sf_dir).filter("w <> 0")
    return reductions.relative_error(g, g.select(*COORDS, F.col("w").alias("v")), "v")


map_query("g072_across", {"mx": "greatest(v, w, x)", "mn": "least(v, w, x)", "am": "greatest(abs(v), abs(w), abs(x))", "sm": "v + w + x", "ml": "w * x * y"},
          lambda g: g.select("*", *[reductions.across(["v", "w", "x"], h).alias(n) for h, n in (("max", "mx"), ("min", "mn"), ("abs_max", "am"), ("sum", "sm"))], reductions.across(["w", "x", "y"], "mul").alias("ml")))


# Vector functions.


def _vectors(g: DataFrame) -> DataFrame:
    a, b = V.vec("x", "y", "z"), (F.col("w") % 25 - 12, F.col("v") % 25, F.col("v") % 7)
    d = V.minus(a, b)
    q, r, mx, mask = V.whole_divide(d, 3), V.remainder(d, 3), V.component_max(a, b), V.min_mask(a)
    return g.select(
        "*", d[0].alias("d0"), q[0].alias("q0"), r[0].alias("r0"), V.negate(d)[1].alias("n1"), V.less(a, b).alias("lt"), V.at_most(a, b).alias("le"), V.equal(a, a).alias("eq"), mx[0].alias("mx0"), V.component_min(a, b)[1].alias("mn1"),
        V.dot(a, b).alias("ab"), V.norm_sq(a).alias("nn"), F.round(V.norm(a), 6).alias("nm"), V.whole_norm(a).alias("nt"), V.index_of_max(a).alias("imax"), V.index_of_min(a).alias("imin"), mask[2].alias("mk2"),
        F.array_join(F.transform(V.order_by_max(a), lambda k: k.cast("string")), "").alias("ord"), V.zeros(a).alias("zs"), V.has_bit(V.set_bit(F.col("x"), 3), 3).alias("bit"),
    )


_D = "(x - (w % 25 - 12))"
map_query("g073_vector_functions", {
    "d0": _D, "q0": f"CAST({_D} // 3 AS BIGINT)", "r0": f"{_D} % 3", "n1": "-(y - v % 25)", "lt": "x < w % 25 - 12 AND y < v % 25 AND z < v % 7", "le": "x <= w % 25 - 12 AND y <= v % 25 AND z <= v % 7", "eq": "true",
    "mx0": "greatest(x, w % 25 - 12)", "mn1": "least(y, v % 25)", "ab": "x * (w % 25 - 12) + y * (v % 25) + z * (v % 7)", "nn": "x * x + y * y + z * z", "nm": "round(sqrt(x * x + y * y + z * z), 6)", "nt": "CAST(floor(sqrt(x * x + y * y + z * z)) AS BIGINT)",
    "imax": "CASE WHEN x >= y AND x >= z THEN 0 WHEN y >= z THEN 1 ELSE 2 END", "imin": "CASE WHEN x <= y AND x <= z THEN 0 WHEN y <= z THEN 1 ELSE 2 END", "mk2": "CASE WHEN z < x AND z < y THEN 1 ELSE 0 END",
    "ord": "CASE WHEN x >= y AND y >= z THEN '012' WHEN x >= z AND z > y THEN '021' WHEN y > x AND x >= z THEN '102' WHEN y >= z AND z > x THEN '120' WHEN z > x AND x >= y THEN '201' ELSE '210' END",
    "zs": "(x = 0)::INT + (y = 0)::INT + (z = 0)::INT", "bit": "true"}, _vectors)


@register("g078_pitch", f"WITH {G} SELECT x, y, z, CAST(x + y * 25 + z * 625 AS BIGINT) AS k, x AS bx, y AS by, z AS bz FROM g")
def _(spark, sf_dir):
    g = orders(spark, sf_dir).select(*COORDS, BOX.pitch().alias("k"))
    return g.select("*", *[c.alias(f"b{n}") for c, n in zip(BOX.coords(F.col("k")), COORDS, strict=True)])


map_query("g081_kernel_math", {"a": "round(sqrt(v) + pow(x, 2) + atan2(y, z + 1), 6)", "b": "round(sin(x) + cos(y) + floor(v / 7.0), 6)", "c": "pow(2.0, x)"},
          lambda g: g.select("*", F.round(F.sqrt(F.col("v").cast("double")) + F.pow("x", F.lit(2)) + F.atan2("y", F.col("z") + 1), 6).alias("a"), F.round(F.sin("x") + F.cos("y") + F.floor(F.col("v") / 7.0), 6).alias("b"), V.double_times(F.col("x")).alias("c")))
map_query("g082_bit_flags", {"m": "CAST(((x % 2) | ((y % 2) << 1) | ((z % 2) << 2)) & 6 AS INTEGER)"},
          lambda g: g.withColumn("m", (F.col("x") % 2).bitwiseOR(F.call_function("shiftleft", F.col("y") % 2, F.lit(1))).bitwiseOR(F.call_function("shiftleft", F.col("z") % 2, F.lit(2))).bitwiseAND(F.lit(6))))


# Slabs and views.


@register("g083_dense_slabs", f"WITH {_SLABS} SELECT x, y, z, slab FROM q")
def _(spark, sf_dir):
    g = tower(spark, sf_dir)
    return g.select(*COORDS, partitions.dense_slab(height(g), 3).alias("slab"))


_CUTS = """s AS (SELECT * FROM g WHERE v % 3 <> 0), pl AS (SELECT z, sum(count(*)) OVER (ORDER BY z) AS upto FROM s GROUP BY z),
e AS (SELECT min(z) AS a, max(z) + 1 AS d, ceil(max(upto) / 3) AS share FROM pl), b0 AS (SELECT e.*, (SELECT min(z) + 1 FROM pl WHERE upto >= share) AS b FROM e),
c0 AS (SELECT *, coalesce((SELECT min(z) + 1 FROM pl WHERE z >= b AND upto - (SELECT upto FROM pl WHERE z = b - 1) >= share), d) AS c FROM b0),
down AS (SELECT a, d, least(b, least(c, d - 3) - 3) AS b, least(c, d - 3) AS c FROM c0), cuts AS (SELECT greatest(b, a + 3) AS b, greatest(c, greatest(b, a + 3) + 3) AS c FROM down)"""


@register("g084_sparse_slabs", f"WITH {TALL}, {_CUTS} SELECT x, y, z, CAST(CASE WHEN z < b THEN 0 WHEN z < c THEN 1 ELSE 2 END AS INTEGER) AS slab FROM s, cuts")
def _(spark, sf_dir):
    s = tower(spark, sf_dir).filter("v % 3 <> 0")
    return s.select(*COORDS, partitions.slab_of(partitions.sparse_bounds(s, 3)).alias("slab"))


@register("g085_cell_properties", f"WITH {_SLABS} SELECT x, y, z, slab, {_VIEW} AS data_view, CASE WHEN k < 2 AND z >= hi - 1 THEN 'UP' WHEN k > 0 AND z < lo + 1 THEN 'DOWN' END AS side FROM q")
def _(spark, sf_dir):
    g = tower(spark, sf_dir)
    return partitions.properties(g, partitions.slab_bounds(height(g), 3))


@register("g086_boundary_span", f"WITH {_SLABS} SELECT x, y, z FROM q WHERE {_VIEW} = 'BOUNDARY'")
def _(spark, sf_dir):
    g = tower(spark, sf_dir)
    return partitions.properties(g, partitions.slab_bounds(height(g), 3)).filter("data_view = 'BOUNDARY'").select(*COORDS)


@register("g089_point_table", f"WITH {G}, {PART} SELECT p.x, p.y, p.z, g.v FROM p LEFT JOIN (SELECT x, y, z, v FROM g WHERE v % 3 <> 0) g USING (x, y, z)")
def _(spark, sf_dir):
    return partitions.lookup(parts(spark, sf_dir).select(*COORDS), sparse(spark, sf_dir).select(*COORDS, "v"))


@register("g138_subset_pull", f"WITH {G}, {PART} SELECT p.x, p.y, p.z, g.v FROM p JOIN g USING (x, y, z)")
def _(spark, sf_dir):
    return subsets.pull(parts(spark, sf_dir), orders(spark, sf_dir), "v")


@register("g138_subset_push", f"WITH {G}, {PART} SELECT g.x, g.y, g.z, coalesce(p.v, g.v) AS v FROM g LEFT JOIN p USING (x, y, z)")
def _(spark, sf_dir):
    return subsets.push(parts(spark, sf_dir), orders(spark, sf_dir).select(*COORDS, "v"), "v")


# Multi-resolution.

#: Levels split by x at 8 and 16, as fixed by the test of parents.
LEVELS = GridSpec(24, 24, 24)
_ML = """f AS (SELECT CAST(i % 24 AS INTEGER) AS x, CAST(i // 24 % 24 AS INTEGER) AS y, CAST(i // 576 AS INTEGER) AS z FROM range(13824) t(i)),
l0 AS (SELECT * FROM f WHERE x < 8), l1 AS (SELECT DISTINCT x - x % 2 AS x, y - y % 2 AS y, z - z % 2 AS z FROM f WHERE x < 16),
l2 AS (SELECT DISTINCT x - x % 4 AS x, y - y % 4 AS y, z - z % 4 AS z FROM f),
m AS (SELECT 0 AS level, x, y, z FROM l0 UNION ALL SELECT 1, x, y, z FROM l1 UNION ALL SELECT 2, x, y, z FROM l2),
r AS (SELECT m.*, c.level IS NOT NULL AS refined FROM m LEFT JOIN (SELECT DISTINCT level + 1 AS level, x - x % (2 << level) AS x, y - y % (2 << level) AS y, z - z % (2 << level) AS z FROM m WHERE level < 2) c USING (level, x, y, z))"""

#: Cells with the place of their parent in columns, so that levels are joined on plain equality.
_UP = "u AS (SELECT *, level + 1 AS up, x - x % (2 << level) AS px, y - y % (2 << level) AS py, z - z % (2 << level) AS pz, 2 << level AS step FROM v)"
_MLM, _UPM = (re.sub(r"\b([fmu]|l0|l1|l2) AS \(", r"\1 AS MATERIALIZED (", c) for c in (_ML, _UP))
_TO_UP = "b.level = a.up AND b.x = a.px AND b.y = a.py AND b.z = a.pz"


def levels(spark: SparkSession, balanced: bool = True) -> DataFrame:
    return multires.build(spark, LEVELS, [F.col("x") < 8, (F.col("x") >= 8) & (F.col("x") < 16), F.col("x") >= 16], balanced)


@register("g090_levels", f"WITH {_ML} SELECT level, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z, refined FROM r")
def _(spark, sf_dir):
    return levels(spark)


@register("g091_culled", f"WITH {_ML}, o AS (SELECT DISTINCT a.level, a.x, a.y, a.z FROM r a CROSS JOIN ({values(S27.without_center()).removeprefix('off(slot, dx, dy, dz) AS (')} t(slot, dx, dy, dz) LEFT JOIN r b ON b.level = a.level AND b.x = a.x + dx * (1 << a.level) AND b.y = a.y + dy * (1 << a.level) AND b.z = a.z + dz * (1 << a.level) WHERE a.refined AND NOT coalesce(b.refined, false) AND a.x + dx * (1 << a.level) BETWEEN 0 AND 23 AND a.y + dy * (1 << a.level) BETWEEN 0 AND 23 AND a.z + dz * (1 << a.level) BETWEEN 0 AND 23) SELECT r.level, CAST(r.x AS INTEGER) AS x, CAST(r.y AS INTEGER) AS y, CAST(r.z AS INTEGER) AS z, refined FROM r LEFT JOIN o USING (level, x, y, z) WHERE NOT (refined AND o.level IS NULL)".replace("(VALUES", "(VALUES").replace("CROSS JOIN (VALUES", "CROSS JOIN (VALUES"))
def _(spark, sf_dir):
    return multires.cull(levels(spark), LEVELS)


@register("g095_children", f"WITH {_ML} SELECT level, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z, count(*) AS children, CAST(sum(w) AS BIGINT) AS child_sum FROM (SELECT level + 1 AS level, x - x % (2 << level) AS x, y - y % (2 << level) AS y, z - z % (2 << level) AS z, x + y + z AS w FROM m WHERE level < 2) GROUP BY level, x, y, z")
def _(spark, sf_dir):
    m = levels(spark).withColumn("w", F.col("x") + F.col("y") + F.col("z"))
    return multires.children(m, "w").select(*multires.LEVEL_COORDS, "children", "child_sum")


@register("g096_parents", f"WITH {_MLM}, v AS MATERIALIZED (SELECT *, level * 1000 + x + y + z AS w FROM m), {_UPM} SELECT a.level, CAST(a.x AS INTEGER) AS x, CAST(a.y AS INTEGER) AS y, CAST(a.z AS INTEGER) AS z, CAST(b.w AS INTEGER) AS parent_value, b.w IS NOT NULL AS has_parent FROM u a LEFT JOIN v b ON {_TO_UP}")
def _(spark, sf_dir):
    m = levels(spark).withColumn("w", F.col("level") * 1000 + F.col("x") + F.col("y") + F.col("z"))
    return multires.with_parent(m, "w").select(*multires.LEVEL_COORDS, "parent_value", "has_parent")


@register("g097_uncles", f"WITH {_MLM}, v AS MATERIALIZED (SELECT *, level * 1000 + x + y + z AS w FROM m), {_UPM}, t AS MATERIALIZED (SELECT * REPLACE (px + step AS px, pz - step AS pz) FROM u) SELECT a.level, CAST(a.x AS INTEGER) AS x, CAST(a.y AS INTEGER) AS y, CAST(a.z AS INTEGER) AS z, CAST(b.w AS INTEGER) AS parent_value, b.w IS NOT NULL AS has_parent FROM t a LEFT JOIN v b ON {_TO_UP}")
def _(spark, sf_dir):
    m = levels(spark).withColumn("w", F.col("level") * 1000 + F.col("x") + F.col("y") + F.col("z"))
    return multires.with_parent(m, "w", (1, 0, -1)).select(*multires.LEVEL_COORDS, "parent_value", "has_parent")


@register("g144_level_stencil", f"WITH {_ML} SELECT a.level, CAST(a.x AS INTEGER) AS x, CAST(a.y AS INTEGER) AS y, CAST(a.z AS INTEGER) AS z, CAST(coalesce(sum(b.x + b.y + b.z), 0) AS BIGINT) AS total, count(b.x) AS neighbours FROM m a LEFT JOIN m b ON a.level = b.level AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = (1 << a.level) GROUP BY a.level, a.x, a.y, a.z".replace("LEFT JOIN m b ON a.level = b.level AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = (1 << a.level)", f"CROSS JOIN (SELECT * FROM (VALUES {', '.join(str(o) for o in S6.offsets)}) t(dx, dy, dz)) o LEFT JOIN m b ON b.level = a.level AND b.x = a.x + dx * (1 << a.level) AND b.y = a.y + dy * (1 << a.level) AND b.z = a.z + dz * (1 << a.level)"))
def _(spark, sf_dir):
    m = levels(spark).withColumn("w", (F.col("x") + F.col("y") + F.col("z")).cast("long"))
    rows = stencils.fold(m, S6, "w", keys=["level"], step=multires.width())
    return rows.select(*multires.LEVEL_COORDS, F.coalesce("total", F.lit(0)).alias("total"), "neighbours")


@register("g146_accumulate_to_parents", f"WITH {_ML}, c AS (SELECT level + 1 AS level, x - x % (2 << level) AS x, y - y % (2 << level) AS y, z - z % (2 << level) AS z, count(*) * 10 AS s FROM m WHERE level < 2 GROUP BY 1, 2, 3, 4) SELECT m.level, CAST(m.x AS INTEGER) AS x, CAST(m.y AS INTEGER) AS y, CAST(m.z AS INTEGER) AS z, CAST(10 + coalesce(s, 0) AS BIGINT) AS w FROM m LEFT JOIN c USING (level, x, y, z)")
def _(spark, sf_dir):
    m = levels(spark).drop("refined").withColumn("w", F.lit(10).cast("long"))
    return multires.accumulate_to_parents(m, "w")


@register("g147_write_children", f"WITH {_MLM}, v AS MATERIALIZED (SELECT * FROM m), {_UPM} SELECT a.level, CAST(a.x AS INTEGER) AS x, CAST(a.y AS INTEGER) AS y, CAST(a.z AS INTEGER) AS z, CAST(coalesce(b.level, a.level) AS INTEGER) AS w FROM u a LEFT JOIN v b ON {_TO_UP}")
def _(spark, sf_dir):
    m = levels(spark).drop("refined").withColumn("w", F.col("level"))
    return multires.write_children(m, "w")


# Lattice Boltzmann.

CAVITY = Cavity(10)
_LAT = "lat(q, cx, cy, cz, wt, op) AS (VALUES " + ", ".join(f"({q}, {c[0]}, {c[1]}, {c[2]}, {w!r}::DOUBLE, {o})" for q, (c, w, o) in enumerate(zip(C19, W19, OPPOSITE_19, strict=True))) + ")"
_CAV = f"""{_LAT}, cells AS (SELECT x, y, z, CASE WHEN x BETWEEN 1 AND 8 AND y BETWEEN 1 AND 8 AND z BETWEEN 1 AND 8 THEN 0 WHEN y = 9 THEN 2 ELSE 1 END AS kind FROM ({CELLS.format(10, 10, 100, 1000)})),
f AS (SELECT x, y, z, kind, q, CASE kind WHEN 0 THEN wt WHEN 2 THEN -6.0 * wt * 0.04 * cx ELSE 0.0 END AS f FROM cells CROSS JOIN lat),
pulled AS (SELECT c.x, c.y, c.z, l.q, l.cx, l.cy, l.cz, l.wt, CASE WHEN l.q = 9 THEN own.f WHEN s.kind = 0 THEN s.f ELSE opp.f + so.f END AS g
 FROM cells c CROSS JOIN lat l JOIN f own ON own.x = c.x AND own.y = c.y AND own.z = c.z AND own.q = l.q JOIN f opp ON opp.x = c.x AND opp.y = c.y AND opp.z = c.z AND opp.q = l.op
 JOIN f s ON s.x = c.x - l.cx AND s.y = c.y - l.cy AND s.z = c.z - l.cz AND s.q = l.q JOIN f so ON so.x = c.x - l.cx AND so.y = c.y - l.cy AND so.z = c.z - l.cz AND so.q = l.op WHERE c.kind = 0),
mom AS (SELECT x, y, z, sum(g) AS rho, sum(g * cx) / sum(g) AS ux, sum(g * cy) / sum(g) AS uy, sum(g * cz) / sum(g) AS uz FROM pulled GROUP BY x, y, z)"""


@register("g101_lattice", f"WITH {_LAT} SELECT q, cx, cy, cz, wt, op FROM lat")
def _(spark, sf_dir):
    rows = [(q, *c, w, o) for q, (c, w, o) in enumerate(zip(C19, W19, OPPOSITE_19, strict=True))]
    return spark.createDataFrame(rows, "q int, cx int, cy int, cz int, wt double, op int")


@register("g103_wall_mask", f"WITH {_CAV} SELECT c.x, c.y, c.z, c.kind, CAST(CASE WHEN c.kind = 0 THEN sum(CASE WHEN n.kind = 0 THEN 0 ELSE 1 << l.q END) ELSE 0 END AS BIGINT) AS wall FROM cells c CROSS JOIN lat l LEFT JOIN cells n ON n.x = c.x - l.cx AND n.y = c.y - l.cy AND n.z = c.z - l.cz WHERE l.q <> 9 GROUP BY c.x, c.y, c.z, c.kind")
def _(spark, sf_dir):
    return uniform.cavity(spark, CAVITY).select(*COORDS, "kind", "wall")


@register("g104_pull_stream", f"WITH {_CAV} SELECT x, y, z, q, round(g, 9) AS g FROM pulled")
def _(spark, sf_dir):
    rows = uniform.pull(uniform.cavity(spark, CAVITY)).filter("kind = 0")
    return rows.select(*COORDS, F.posexplode("g").alias("q", "g")).withColumn("g", F.round("g", 9))


@register("g105_macroscopic", f"WITH {_CAV} SELECT x, y, z, round(rho, 9) AS rho, round(ux, 9) AS ux, round(uy, 9) AS uy, round(uz, 9) AS uz FROM mom")
def _(spark, sf_dir):
    rows = uniform.pull(uniform.cavity(spark, CAVITY)).filter("kind = 0").select(*COORDS, *uniform.macroscopic("g"))
    return rows.select(*COORDS, *[(F.round(c, 9) + 0.0).alias(c) for c in ("rho", "ux", "uy", "uz")])


@register("g109_lbm_step", f"WITH {_CAV} SELECT x, y, z, q, round((1 - o) * g + o * rho * wt * (1 + 3 * cu + 4.5 * cu * cu - 1.5 * (ux * ux + uy * uy + uz * uz)), 9) AS f FROM (SELECT p.*, rho, ux, uy, uz, cx * ux + cy * uy + cz * uz AS cu, {CAVITY.omega!r}::DOUBLE AS o FROM pulled p JOIN mom USING (x, y, z))")
def _(spark, sf_dir):
    rows = uniform.run(uniform.cavity(spark, CAVITY), CAVITY.omega, 1, cut_every=1).filter("kind = 0")
    return rows.select(*COORDS, F.posexplode("f").alias("q", "f")).withColumn("f", F.round("f", 9))


@register("g109_lbm_step_blocks", f"WITH {_CAV} SELECT x, y, z, q, round((1 - o) * g + o * rho * wt * (1 + 3 * cu + 4.5 * cu * cu - 1.5 * (ux * ux + uy * uy + uz * uz)), 9) AS f FROM (SELECT p.*, rho, ux, uy, uz, cx * ux + cy * uy + cz * uz AS cu, {CAVITY.omega!r}::DOUBLE AS o FROM pulled p JOIN mom USING (x, y, z))")
def _(spark, sf_dir):
    rows = uniform.step_blocks(uniform.cavity(spark, CAVITY), CAVITY.omega, 8).filter("kind = 0")
    return rows.select(*COORDS, F.posexplode("f").alias("q", "f")).withColumn("f", F.round("f", 9))


def _cavity_steps(steps: int) -> str:
    """The cavity's CTEs up to the moments after so many steps, each step's populations under its own number."""
    head, rest = _CAV.split("\npulled AS (")
    body, moments = rest.split("\nmom AS (")
    out = head.replace("cells AS (", "cells AS MATERIALIZED (").replace("\nf AS (", "\nf0 AS MATERIALIZED (").rstrip(",")
    for k in range(steps + 1):
        out += f",\npulled{k} AS MATERIALIZED (" + body.rstrip().rstrip(",").replace("JOIN f ", f"JOIN f{k} ")
        out += f",\nmom{k} AS MATERIALIZED (" + moments.replace("FROM pulled", f"FROM pulled{k}")
        out += f""",\nf{k + 1} AS MATERIALIZED (SELECT x, y, z, 0 AS kind, q, (1 - o) * g + o * rho * wt * (1 + 3 * cu + 4.5 * cu * cu - 1.5 * (ux * ux + uy * uy + uz * uz)) AS f
 FROM (SELECT p.*, rho, ux, uy, uz, cx * ux + cy * uy + cz * uz AS cu, {CAVITY.omega!r}::DOUBLE AS o FROM pulled{k} p JOIN mom{k} USING (x, y, z)) UNION ALL SELECT x, y, z, kind, q, f FROM f{k} WHERE kind <> 0)"""
    return out


@register("g110_lbm_export", f"WITH {_cavity_steps(4)} SELECT x, y, z, round(coalesce(rho, CASE WHEN kind = 2 THEN 1 ELSE 0 END), 9) AS rho, round(coalesce(ux, CASE WHEN kind = 2 THEN 0.04::DOUBLE ELSE 0 END), 9) + 0.0::DOUBLE AS ux, round(coalesce(uy, 0), 9) + 0.0::DOUBLE AS uy, round(coalesce(uz, 0), 9) + 0.0::DOUBLE AS uz FROM cells LEFT JOIN mom4 USING (x, y, z)")
def _(spark, sf_dir):
    rows = uniform.export(uniform.run(uniform.cavity(spark, CAVITY), CAVITY.omega, 4))
    return rows.select(*COORDS, *[(F.round(c, 9) + 0.0).alias(c) for c in ("rho", "ux", "uy", "uz")])


@register("g111_cavity_init", f"WITH {_CAV} SELECT x, y, z, kind, q, round(f, 12) AS f FROM f")
def _(spark, sf_dir):
    rows = uniform.cavity(spark, CAVITY)
    return rows.select(*COORDS, "kind", F.posexplode("f").alias("q", "f")).withColumn("f", F.round("f", 12) + 0.0)


@register("g112_cavity_parameters", "SELECT n, 0.04 * (n - 2) / 100.0 AS viscosity, 1.0 / (3.0 * (0.04 * (n - 2) / 100.0) + 0.5) AS omega, 1.0 / (n - 2) AS dx, 0.04 / (n - 2) AS dt FROM (VALUES (10::DOUBLE), (66::DOUBLE), (160::DOUBLE)) t(n)")
def _(spark, sf_dir):
    rows = [(float(n), c.viscosity, c.omega, c.dx, c.dt) for n in (10, 66, 160) for c in (Cavity(n),)]
    return spark.createDataFrame(rows, "n double, viscosity double, omega double, dx double, dt double")


# Solver: between two plates the solution is a straight line along z.


@register("g125_poisson", f"WITH c AS ({CELLS.format(4, 4, 16, 144)}) SELECT x, y, z, round(-20 + 5.0 * z, 4)::DOUBLE AS u FROM c")
def _(spark, sf_dir):
    plates = (F.col("z") > 0) & (F.col("z") < 8)
    u = F.when(F.col("z") == 0, -20.0).when(F.col("z") == 8, 20.0).otherwise(0.0)
    grid = source.dense(spark, GridSpec(4, 4, 9)).select(*COORDS, u.alias("u"), F.lit(0.0).alias("b"), plates.cast("int").alias("boundary"))
    solved, _end = cg.solve(grid, parameters=cg.Parameters(relative=1e-10))
    return solved.select(*COORDS, (F.round("u", 4) + 0.0).alias("u"))


# Further rows: levels, verification, boundaries.


@register("g046_neighbour_index", f"WITH {SPARSE}, {around(Stencil(((-1, 0, 1),)), 's')} SELECT x, y, z, CAST(CASE WHEN ok THEN x - 1 ELSE -1 END AS INTEGER) AS ix, CAST(CASE WHEN ok THEN y ELSE -1 END AS INTEGER) AS iy, CAST(CASE WHEN ok THEN z + 1 ELSE -1 END AS INTEGER) AS iz FROM nb")
def _(spark, sf_dir):
    own = sparse(spark, sf_dir).select(*COORDS, *[F.col(c).alias(f"i{c}") for c in COORDS])
    got = stencils.gather(own, Stencil(((-1, 0, 1),)), ["ix", "iy", "iz"])
    return got.select(*COORDS, *[F.when(F.col("valid0"), F.col(f"n0_i{c}")).otherwise(-1).alias(f"i{c}") for c in COORDS])


@register("g020_mesh_inside", f"WITH c AS ({CELLS.format(12, 12, 144, 1728)}) SELECT x, y, z, abs(x - 5.6) < 3 AND abs(y - 5.6) < 3 AND abs(z - 5.6) < 3 AS inside FROM c")
def _(spark, sf_dir):
    import numpy as np

    from gridloom.sources import mesh

    corners = np.array([[a, b, c] for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)], float)
    quads = ((0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3))
    faces = np.array([t for a, b, c, d in quads for t in ((a, b, c), (a, c, d))])
    placed = mesh.fit(corners, (5.6, 5.6, 5.6), 6.0)
    return mesh.with_mesh(source.dense(spark, GridSpec(12, 12, 12)), placed, faces).select(*COORDS, "inside")


@register("g094_has_children", f"WITH {_ML} SELECT level, count(*) AS cells, count(*) FILTER (refined) AS refined FROM r GROUP BY level")
def _(spark, sf_dir):
    return levels(spark).groupBy("level").agg(F.count(F.lit(1)).alias("cells"), F.count(F.when(F.col("refined"), 1)).alias("refined"))


_BALANCED = f"""f AS ({CELLS.format(32, 8, 256, 2048)}), corner AS (SELECT i % 2 AS i, i // 2 % 2 AS j, i // 4 AS k FROM range(8) t(i)),
d AS (SELECT i % 3 - 1 AS dx, i // 3 % 3 - 1 AS dy, i // 9 - 1 AS dz FROM range(27) t(i)),
given AS (SELECT 0 AS level, x, y, z FROM f WHERE x < 2 UNION SELECT 1, x - x % 4 + 2 * i, y - y % 4 + 2 * j, z - z % 4 + 2 * k FROM f, corner WHERE x < 2 UNION SELECT 2, x - x % 4, y - y % 4, z - z % 4 FROM f),
asked AS (SELECT level, x, y, z FROM given UNION SELECT up, px - CASE WHEN up < 2 THEN px % (2 << up) - (i << up) ELSE 0 END, py - CASE WHEN up < 2 THEN py % (2 << up) - (j << up) ELSE 0 END, pz - CASE WHEN up < 2 THEN pz % (2 << up) - (k << up) ELSE 0 END
 FROM (SELECT level + 1 AS up, nx - nx % (2 << level) AS px, ny - ny % (2 << level) AS py, nz - nz % (2 << level) AS pz
  FROM (SELECT level, x + dx * (1 << level) AS nx, y + dy * (1 << level) AS ny, z + dz * (1 << level) AS nz FROM asked, d WHERE level < 2) WHERE nx BETWEEN 0 AND 31 AND ny BETWEEN 0 AND 7 AND nz BETWEEN 0 AND 7), corner)"""


@register("g092_balanced", f"WITH RECURSIVE {_BALANCED} SELECT CAST(a.level AS INTEGER) AS level, CAST(a.x AS INTEGER) AS x, CAST(a.y AS INTEGER) AS y, CAST(a.z AS INTEGER) AS z, c.level IS NOT NULL AS refined FROM asked a LEFT JOIN (SELECT DISTINCT level + 1 AS level, x - x % (2 << level) AS x, y - y % (2 << level) AS y, z - z % (2 << level) AS z FROM asked WHERE level < 2) c USING (level, x, y, z)")
def _(spark, sf_dir):
    return multires.build(spark, GridSpec(32, 8, 8), [F.col("x") < 2, F.lit(False), F.lit(True)], True)


@register("g098_uncle_offset", "SELECT CAST(i AS INTEGER) AS i, CAST(q AS INTEGER) AS q, CAST(CASE WHEN i + q <= 0 THEN i + q ELSE i + q - 1 END AS INTEGER) AS off FROM range(2) a(i), range(-1, 2) b(q)")
def _(spark, sf_dir):
    return spark.createDataFrame([(i, q, multires.uncle_offset(i, q)) for i in (0, 1) for q in (-1, 0, 1)], "i int, q int, off int")


@register("g099_level_omega", "SELECT CAST(l AS INTEGER) AS level, 2 * 1.7::DOUBLE / (pow(2, 4 - l) + (1 - pow(2, 3 - l)) * 1.7::DOUBLE) AS omega FROM range(4) t(l)")
def _(spark, sf_dir):
    return spark.createDataFrame([(lv, multires.omega(1.7, lv, 4)) for lv in range(4)], "level int, omega double")


@register("g145_parents_downward", f"WITH {_ML}, v AS (SELECT *, level * 100 + x // 4 AS w FROM m), {_UP}, once AS (SELECT a.* REPLACE (coalesce(b.w, a.w) AS w) FROM u a LEFT JOIN v b ON {_TO_UP}) SELECT a.level, CAST(a.x AS INTEGER) AS x, CAST(a.y AS INTEGER) AS y, CAST(a.z AS INTEGER) AS z, CAST(coalesce(b.w, a.w) AS INTEGER) AS w FROM once a LEFT JOIN once b ON {_TO_UP}")
def _(spark, sf_dir):
    m = levels(spark).drop("refined").withColumn("w", (F.col("level") * 100 + F.floor(F.col("x") / 4)).cast("int"))
    return multires.write_children(multires.write_children(m, "w"), "w")


@register("g152_hexahedra", f"WITH {_ML}, k(corner, dx, dy, dz) AS (VALUES (0, 0, 0, 0), (1, 1, 0, 0), (2, 1, 1, 0), (3, 0, 1, 0), (4, 0, 0, 1), (5, 1, 0, 1), (6, 1, 1, 1), (7, 0, 1, 1)) SELECT level, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z, corner, CAST(x + dx * (1 << level) AS INTEGER) AS px, CAST(y + dy * (1 << level) AS INTEGER) AS py, CAST(z + dz * (1 << level) AS INTEGER) AS pz FROM r, k WHERE NOT refined")
def _(spark, sf_dir):
    from gridloom.sources import sinks

    return sinks.hexahedra(levels(spark))


def _fluid(spark: SparkSession, sf_dir: str, c, w) -> DataFrame:
    """part's cells with populations near the weights, disturbed by the key; by number, since many cells make a small file."""
    p = parts(spark, sf_dir).select(*COORDS)
    p = p.repartition(max(spark.sparkContext.defaultParallelism, -(-p.count() // SHARE)), *[F.floor(F.col(n) / SHARE_SIDE) for n in COORDS])
    k = RAGGED.pitch()
    return p.select(*COORDS, F.array(*[F.lit(t) * (1.0 + ((k * (q + 3)) % 11).cast("double") / 100.0) for q, t in enumerate(w)]).alias("f"))


def _fluid_sql(c, w) -> str:
    lat = ", ".join(f"({q}, {d[0]}, {d[1]}, {d[2]}, {t!r}::DOUBLE)" for q, (d, t) in enumerate(zip(c, w, strict=True)))
    return f"""{PART}, lat(q, cx, cy, cz, wt) AS (VALUES {lat}), f AS (SELECT x, y, z, q, cx, cy, cz, wt, wt * (1 + ((x + 16 * y + 256 * z) * (q + 3)) % 11 / 100.0::DOUBLE) AS f FROM p CROSS JOIN lat),
mom AS (SELECT x, y, z, sum(f) AS rho, sum(f * cx) / sum(f) AS ux, sum(f * cy) / sum(f) AS uy, sum(f * cz) / sum(f) AS uz FROM f GROUP BY x, y, z)"""



_EQ = "rho * wt * (1 + 3 * cu + 4.5 * cu * cu - 1.5 * (ux * ux + uy * uy + uz * uz))"


@register("g106_collide", f"WITH {_fluid_sql(C19, W19)} SELECT x, y, z, q, round(-0.2::DOUBLE * f + 1.2::DOUBLE * {_EQ}, 9) AS o FROM (SELECT f.*, rho, ux, uy, uz, cx * ux + cy * uy + cz * uz AS cu FROM f JOIN mom USING (x, y, z))")
def _(spark, sf_dir):
    rows = level_flow.collide_bgk(_fluid(spark, sf_dir, C19, W19), C19, W19, 1.2)
    return rows.select(*COORDS, F.posexplode("o").alias("q", "o")).withColumn("o", F.round("o", 9))


@register("g107_collide_generic", f"WITH {_fluid_sql(C27, W27)} SELECT x, y, z, q, round(-0.2::DOUBLE * f + 1.2::DOUBLE * {_EQ}, 9) AS o FROM (SELECT f.*, rho, ux, uy, uz, cx * ux + cy * uy + cz * uz AS cu FROM f JOIN mom USING (x, y, z))")
def _(spark, sf_dir):
    rows = level_flow.collide_bgk(_fluid(spark, sf_dir, C27, W27), C27, W27, 1.2)
    return rows.select(*COORDS, F.posexplode("o").alias("q", "o")).withColumn("o", F.round("o", 9))


_KBC = f"""{_fluid_sql(C27, W27)}, r AS (SELECT *, f - eq AS rest FROM (SELECT *, {_EQ} AS eq FROM (SELECT f.*, rho, ux, uy, uz, cx * ux + cy * uy + cz * uz AS cu FROM f JOIN mom USING (x, y, z)))),
flux AS (SELECT x, y, z, sum(rest * cx * cx) AS xx, sum(rest * cx * cy) AS xy, sum(rest * cx * cz) AS xz, sum(rest * cy * cy) AS yy, sum(rest * cy * cz) AS yz, sum(rest * cz * cz) AS zz FROM r GROUP BY x, y, z),
parted AS (SELECT *, rest - s AS h FROM (SELECT r.*, rho * CASE abs(cx) + abs(cy) + abs(cz) WHEN 1 THEN ((3 * cx * cx - 1) * xx + (3 * cy * cy - 1) * yy + (3 * cz * cz - 1) * zz) / 6 WHEN 2 THEN (cx * cy * xy + cx * cz * xz + cy * cz * yz) / 4 ELSE 0 END AS s FROM r JOIN flux USING (x, y, z))),
gamma AS (SELECT x, y, z, 1 / 0.85::DOUBLE - (2 - 1 / 0.85::DOUBLE) * sum(s * h / eq) / (1e-7::DOUBLE + sum(h * h / eq)) AS gamma FROM parted GROUP BY x, y, z)"""


@register("g108_collide_kbc", f"WITH {_KBC} SELECT x, y, z, q, round(f - 0.85::DOUBLE * (2 * s + gamma * h), 9) AS o FROM parted JOIN gamma USING (x, y, z)")
def _(spark, sf_dir):
    rows = level_flow.collide_kbc(_fluid(spark, sf_dir, C27, W27), C27, W27, 1.7)
    return rows.select(*COORDS, F.posexplode("o").alias("q", "o")).withColumn("o", F.round("o", 9))


@register("g113_flow_over_sphere", f"WITH {_LAT}, c AS (SELECT *, CASE WHEN y IN (0, 10) OR z IN (0, 10) OR (x - 8) * (x - 8) + (y - 5) * (y - 5) + (z - 5) * (z - 5) <= 6.25 THEN 1 WHEN x = 0 THEN 2 ELSE 0 END AS kind FROM ({CELLS.format(20, 11, 220, 2420)})) SELECT x, y, z, kind, q, round(CASE kind WHEN 0 THEN wt WHEN 2 THEN -6 * wt * 0.05 * cx ELSE 0 END, 9) + 0.0::DOUBLE AS f FROM c CROSS JOIN lat")
def _(spark, sf_dir):
    ball = source.signed_distance("sphere", (8, 5, 5), 2.5) <= 0
    cells = level_flow.flow_over(source.dense(spark, GridSpec(20, 11, 11)), (20, 11, 11), ball, 0.05, C19, W19)
    return cells.select(*COORDS, "kind", F.posexplode("f").alias("q", "f")).withColumn("f", F.round("f", 9) + 0.0)


def _two_levels(spark: SparkSession) -> DataFrame:
    cells = multires.build(spark, GridSpec(12, 8, 8), [F.col("x") < 6, F.lit(True)])
    return level_flow.at_rest(cells, (12, 8, 8), 2, C19, W19, 0.05)


_TWO = f"""{_LAT}, cells AS (SELECT 0 AS level, x, y, z, 1 AS w, false AS refined FROM ({CELLS.format(6, 8, 48, 384)}) UNION ALL SELECT 1, 2 * x, 2 * y, 2 * z, 2, x < 3 FROM ({CELLS.format(6, 4, 24, 96)})),
o AS (SELECT level, x, y, z, refined, q, cx, cy, cz, CASE WHEN NOT face AND NOT refined THEN wt WHEN face AND y + w >= 8 THEN -6 * wt * 0.05 * cx ELSE 0 END AS o
 FROM (SELECT *, x = 0 OR y = 0 OR z = 0 OR x + w >= 12 OR y + w >= 8 OR z + w >= 8 AS face FROM cells) CROSS JOIN lat),
pushed AS (SELECT *, CAST(2 * floor((x + cx) / 2) AS INTEGER) - 2 * cx AS sx, CAST(2 * floor((y + cy) / 2) AS INTEGER) - 2 * cy AS sy, CAST(2 * floor((z + cz) / 2) AS INTEGER) - 2 * cz AS sz FROM o WHERE level = 0 AND q <> 9),
sent AS (SELECT q, o, sx, sy, sz, x + CAST(floor((sx - x + x % 2) / 2) AS INTEGER) AS kx, y + CAST(floor((sy - y + y % 2) / 2) AS INTEGER) AS ky, z + CAST(floor((sz - z + z % 2) / 2) AS INTEGER) AS kz FROM pushed p
 WHERE NOT EXISTS (FROM cells n WHERE n.level = 0 AND n.x = p.x + p.cx AND n.y = p.y + p.cy AND n.z = p.z + p.cz)
 AND EXISTS (FROM cells n WHERE n.level = 1 AND n.x = p.sx + 2 * p.cx AND n.y = p.sy + 2 * p.cy AND n.z = p.sz + 2 * p.cz) AND EXISTS (FROM cells n WHERE n.level = 1 AND n.x = p.sx AND n.y = p.sy AND n.z = p.sz))"""
_STORED = "SELECT CAST(o.level AS INTEGER) AS level, o.x, o.y, o.z, o.q, round(o.o + coalesce(a.v, 0), 9) + 0.0::DOUBLE AS o FROM o LEFT JOIN a ON a.sx = o.x AND a.sy = o.y AND a.sz = o.z AND a.q = o.q WHERE o.level = 1 AND o.refined"


@register("g116_store_weights", f"WITH {_TWO} SELECT CAST(1 AS INTEGER) AS level, sx AS x, sy AS y, sz AS z, q, 1 / (2 * CAST(count(*) AS DOUBLE)) AS weight FROM sent GROUP BY sx, sy, sz, q")
def _(spark, sf_dir):
    return _two_levels(spark).select(*multires.LEVEL_COORDS, F.posexplode("weight").alias("q", "weight")).filter("weight > 0")


@register("g115_store_fine", f"WITH {_TWO}, a AS (SELECT sx, sy, sz, q, sum(o) AS v FROM sent s WHERE EXISTS (FROM cells n WHERE n.level = 0 AND n.x = s.kx AND n.y = s.ky AND n.z = s.kz) GROUP BY sx, sy, sz, q) {_STORED}")
def _(spark, sf_dir):
    rows = level_flow.store_fine(_two_levels(spark), 0, C19).filter("refined")
    return rows.select(*multires.LEVEL_COORDS, F.posexplode("o").alias("q", "o")).withColumn("o", F.round("o", 9) + 0.0)


@register("g114_store_coarse", f"WITH {_TWO}, a AS (SELECT sx, sy, sz, q, avg(o) AS v FROM sent GROUP BY sx, sy, sz, q) {_STORED}")
def _(spark, sf_dir):
    rows = level_flow.store_coarse(_two_levels(spark), 1, C19).filter("refined")
    return rows.select(*multires.LEVEL_COORDS, F.posexplode("o").alias("q", "o")).withColumn("o", F.round("o", 9) + 0.0)


@register("g117_explosion_coalescence_stream")
def _(spark, sf_dir):
    rows = level_flow.stream(level_flow.stream(_two_levels(spark), 0, C19), 1, C19).filter("NOT refined")
    return rows.select(*multires.LEVEL_COORDS, F.posexplode("f").alias("q", "f")).withColumn("f", F.round("f", 9))


@register("g121_nonuniform_step")
def _(spark, sf_dir):
    rows = level_flow.advance(_two_levels(spark), 1, 2, 1.5, C19, W19).filter("NOT refined")
    return rows.select(*multires.LEVEL_COORDS, "kind", F.round(F.aggregate("f", F.lit(0.0), lambda a, v: a + v), 9).alias("mass"))


@register("g122_zou_he_pressure", f"WITH {_fluid_sql(C19, W19)} SELECT x, y, z, round(1 - (sum(f) FILTER (cx = 0) + 2 * sum(f) FILTER (cx < 0)) / 1.02::DOUBLE, 9) AS ux FROM f WHERE x = 0 GROUP BY x, y, z")
def _(spark, sf_dir):
    rows = boundaries.zou_he(_fluid(spark, sf_dir, C19, W19).filter("x = 0"), "f", (1, 0, 0), rho=1.02)
    return rows.select(*COORDS, F.round("ux", 9).alias("ux"))


@register("g122_zou_he_velocity", f"WITH {_fluid_sql(C19, W19)} SELECT x, y, z, round((sum(f) FILTER (cx = 0) + 2 * sum(f) FILTER (cx < 0)) / 0.95::DOUBLE, 9) AS rho FROM f WHERE x = 0 GROUP BY x, y, z")
def _(spark, sf_dir):
    rows = boundaries.zou_he(_fluid(spark, sf_dir, C19, W19).filter("x = 0"), "f", (1, 0, 0), speed=0.05)
    return rows.select(*COORDS, F.round("rho", 9).alias("rho"))


@register("g123_tau_collide_stream", f"WITH {_fluid_sql(C19, W19)}, o AS (SELECT f.x, f.y, f.z, q, cx, cy, cz, (1 - 1 / 0.8::DOUBLE) * f + {_EQ} / 0.8::DOUBLE AS o FROM (SELECT f.*, rho, ux, uy, uz, cx * ux + cy * uy + cz * uz AS cu FROM f JOIN mom USING (x, y, z)) f) SELECT f.x, f.y, f.z, f.q, round(coalesce(o.o, 0), 9) AS f FROM f LEFT JOIN o ON o.x = f.x - f.cx AND o.y = f.y - f.cy AND o.z = f.z - f.cz AND o.q = f.q")
def _(spark, sf_dir):
    rows = _fluid(spark, sf_dir, C19, W19).withColumn("mask", F.lit(1)).withColumns({n: F.lit(0.0) for n in ("rho", "ux", "uy", "uz")})
    rows = boundaries.tau_collide_stream(boundaries.tau_macroscopic(rows, C19), C19, W19, 0.8)
    return rows.select(*COORDS, F.posexplode("f").alias("q", "f")).withColumn("f", F.round("f", 9))


@register("g124_centre_line_error", "WITH p(pos, expected) AS (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in zip(verify.Y_POSITIONS, verify.U_ALONG_Y[100], strict=True)) + ") SELECT round(max(abs(pos * pos - 0.01 - expected + least(0, 0)) / CASE WHEN expected = 0 THEN 1 ELSE abs(expected) END), 2) AS error FROM p")
def _(spark, sf_dir):
    fine = spark.range(0, 2001).select((F.col("id") / 2000.0).alias("pos")).select("pos", (F.col("pos") * F.col("pos") - 0.01).alias("value"))
    return verify.worst_error(fine, 100).select(F.round("error", 2).alias("error"))


@register("g151_sum", f"WITH {G} SELECT x, y, z, v + w AS c FROM g")
def _(spark, sf_dir):
    return maps.apply(orders(spark, sf_dir), maps.add("v", "w", "c")).select(*COORDS, "c")


@register("g043_static_offset", f"WITH {G}, {around(Stencil(((-2, 1, 0),)), 'g')} SELECT x, y, z, v, CASE WHEN ok THEN nv ELSE -1 END AS value, ok AS valid FROM nb")
def _(spark, sf_dir):
    return stencils.neighbour(orders(spark, sf_dir), (-2, 1, 0), "v", F.lit(-1).cast("long"))


@register("g048_stencil_algebra", "SELECT * FROM (VALUES (0, 0, 0, 0), (1, 0, 0, -1), (2, 0, 0, 1), (3, 0, -1, 0), (4, 0, 1, 0), (5, -1, 0, 0), (6, 1, 0, 0), (7, -1, -1, 0), (8, -1, 1, 0), (9, 1, -1, 0), (10, 1, 1, 0), (11, 2, 0, 0)) t(slot, dx, dy, dz)")
def _(spark, sf_dir):
    joined = Stencil.union(S7, MOORE).add((1, 1, 0)).add((2, 0, 0))
    return spark.createDataFrame([(joined.find(o), *o) for o in joined], "slot int, dx int, dy int, dz int")


@register("g079_inside_box", f"WITH {G} SELECT x, y, z, x >= 3 AND y < 23 AND z BETWEEN 1 AND 2 AS inside FROM g")
def _(spark, sf_dir):
    box = GridSpec(25, 25, 2)
    return orders(spark, sf_dir).select(*COORDS, box.inside(F.col("x") - 3, F.col("y") + 2, F.col("z") - 1).alias("inside"))


@register("g102_lattice", "SELECT CAST(9 * i + 3 * j + k AS INTEGER) AS q, CAST([0, -1, 1][i + 1] AS INTEGER) AS cx, CAST([0, -1, 1][j + 1] AS INTEGER) AS cy, CAST([0, -1, 1][k + 1] AS INTEGER) AS cz, [8 / 27::DOUBLE, 2 / 27::DOUBLE, 1 / 54::DOUBLE, 1 / 216::DOUBLE][1 + least(i, 1) + least(j, 1) + least(k, 1)] AS wt, CAST(9 * ((3 - i) % 3) + 3 * ((3 - j) % 3) + (3 - k) % 3 AS INTEGER) AS op FROM range(3) a(i), range(3) b(j), range(3) c(k)")
def _(spark, sf_dir):
    rows = [(q, *c, w, o) for q, (c, w, o) in enumerate(zip(C27, W27, OPPOSITE_27, strict=True))]
    return spark.createDataFrame(rows, "q int, cx int, cy int, cz int, wt double, op int")


@register("g132_fold_with", f"WITH {G}, {around(S27, 'g')} SELECT x, y, z, v, max(nv) FILTER (ok) AS total, count(*) FILTER (ok) AS neighbours FROM nb GROUP BY x, y, z, v")
def _(spark, sf_dir):
    return stencils.fold(orders(spark, sf_dir), S27, "v", fn=F.max).select(*COORDS, "v", "total", "neighbours")


@register("g010_dense_round_trip", f"WITH {G} SELECT x, y, z, v::DOUBLE AS c0, w::DOUBLE AS c1 FROM g WHERE z < 2")
def _(spark, sf_dir):
    field = orders(spark, sf_dir).filter("z < 2")
    grid = GridSpec(25, 25, 2)
    return source.from_dense(spark, field.select(*COORDS), source.to_dense(spark, grid, field, ["v", "w"]))


@register("g013_vtk_text", f"WITH {G}, n AS (SELECT max(z) AS top FROM g), c AS (SELECT CAST(i % 25 AS INTEGER) AS x, CAST(i // 25 AS INTEGER) AS y FROM range(625) t(i)), p AS (SELECT DISTINCT z FROM g) SELECT p.z, md5(string_agg(coalesce(g.v, -1) || ' ' || coalesce(g.w, -1) || chr(10), '' ORDER BY c.y, c.x)) AS digest FROM p CROSS JOIN c LEFT JOIN g ON g.x = c.x AND g.y = c.y AND g.z = p.z GROUP BY p.z")
def _(spark, sf_dir):
    field = orders(spark, sf_dir)
    return sinks.encoded(field, GridSpec(25, 25, height(field)), ["v", "w"], sinks.TEXT, -1.0).select("z", F.md5("data").alias("digest"))


@register("g015_domain_field", f"WITH {TALL}, {_QUARTERS} SELECT z, md5(string_agg(slab || chr(10), '' ORDER BY i)) AS digest FROM (SELECT p.z, i, coalesce(CASE WHEN g.x IS NOT NULL THEN slab END, -1) AS slab FROM (SELECT DISTINCT z FROM g) p CROSS JOIN range(25) t(i) JOIN b ON p.z >= low AND p.z < high LEFT JOIN g ON g.x = i % 5 AND g.y = i // 5 AND g.z = p.z) GROUP BY z")
def _(spark, sf_dir):
    cells = tower(spark, sf_dir)
    nz = height(cells)
    field = cells.select(*COORDS, partitions.dense_slab(nz, 4).alias("domain"))
    return sinks.encoded(field, GridSpec(5, 5, nz), ["domain"], sinks.TEXT, -1.0).select("z", F.md5("data").alias("digest"))


@register("g063_same_grid", f"WITH {G}, a AS (SELECT x, y, z FROM g WHERE v % 3 <> 0), b AS (SELECT x, y, z FROM g WHERE v % 5 <> 0) SELECT x, y, z, CAST(1 AS BIGINT) AS count FROM (FROM a EXCEPT FROM b) UNION ALL SELECT x, y, z, CAST(-1 AS BIGINT) FROM (FROM b EXCEPT FROM a)")
def _(spark, sf_dir):
    g = orders(spark, sf_dir)
    return reductions.grid_differences(g.filter("v % 3 <> 0"), g.filter("v % 5 <> 0"))


_LOADED = f"WITH {_ML}, v AS (SELECT *, level * 1000 + x + y + z AS w FROM m), {_UP}, d AS (SELECT px, py, pz, sum(w) AS s FROM u WHERE level = 0 GROUP BY px, py, pz)"


@register("g093_load_modes", f"""{_LOADED}, q AS (SELECT 'map' AS mode, x, y, z, w AS value FROM v WHERE level = 1
UNION ALL SELECT 'stencil', a.x, a.y, a.z, sum(coalesce(b.w, 0)) FROM v a CROSS JOIN (VALUES {', '.join(str(o) for o in S6.offsets)}) o(dx, dy, dz) LEFT JOIN v b ON b.level = a.level AND b.x = a.x + 2 * dx AND b.y = a.y + 2 * dy AND b.z = a.z + 2 * dz WHERE a.level = 1 GROUP BY a.x, a.y, a.z
UNION ALL SELECT 'stencil_up', a.x, a.y, a.z, coalesce(b.w, -1) FROM u a LEFT JOIN v b ON {_TO_UP} WHERE a.level = 1
UNION ALL SELECT 'stencil_down', v.x, v.y, v.z, coalesce(s, -1) FROM v LEFT JOIN d ON x = px AND y = py AND z = pz WHERE level = 1)
SELECT mode, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z, CAST(value AS BIGINT) AS value FROM q""")
def _(spark, sf_dir):
    m = levels(spark).withColumn("w", F.col("level") * 1000 + F.col("x") + F.col("y") + F.col("z"))
    near = reduce(lambda a, b: a + b, [F.coalesce(f"n{k}_w", F.lit(0)) for k in range(len(S6))])
    values = {multires.MAP: F.col("w"), multires.STENCIL: near, multires.STENCIL_UP: F.coalesce("parent_value", F.lit(-1)), multires.STENCIL_DOWN: F.coalesce("child_sum", F.lit(-1))}
    return reduce(DataFrame.unionByName, [multires.load(m, 1, 3, "w", k).select(F.lit(k).alias("mode"), *COORDS, v.cast("long").alias("value")) for k, v in values.items()])


@register("g100_level_field", f"WITH {_MLM}, v AS MATERIALIZED (SELECT *, 10 * (level + 1) AS w FROM m), {_UPM} SELECT a.level, CAST(a.x AS INTEGER) AS x, CAST(a.y AS INTEGER) AS y, CAST(a.z AS INTEGER) AS z, CAST(a.w + CASE WHEN a.level = 0 THEN 7 WHEN a.level = 1 THEN coalesce(b.w, 0) ELSE 0 END AS INTEGER) AS w FROM u a LEFT JOIN v b ON {_TO_UP}")
def _(spark, sf_dir):
    m = multires.new_field(levels(spark).drop("refined"), [10, 20, 30], "w")
    m = multires.on_level(m, 1, 3, "w", "w", lambda r: F.col("w") + F.coalesce("parent_value", F.lit(0)), multires.STENCIL_UP)
    return multires.on_level(m, 0, 3, "w", "w", lambda r: F.col("w") + 7)


@register("g132_reduce_with", f"WITH {G} SELECT bit_xor(v) AS value FROM g")
def _(spark, sf_dir):
    return reductions.reduce_with(orders(spark, sf_dir), "v", np.bitwise_xor, 0)


@register("g148_staggered_ids", f"WITH {PART}, n AS (SELECT DISTINCT x + a AS x, y + b AS y, z + c AS z FROM p, range(2) i(a), range(2) j(b), range(2) k(c)) SELECT p.x, p.y, p.z, count(*) FILTER (n.x % 5 <> 0) AS matches, count(*) FILTER (n.x % 5 = 0) AS mismatches FROM p JOIN n ON n.x - p.x BETWEEN 0 AND 1 AND n.y - p.y BETWEEN 0 AND 1 AND n.z - p.z BETWEEN 0 AND 1 GROUP BY p.x, p.y, p.z")
def _(spark, sf_dir):
    p = parts(spark, sf_dir)
    nodes = staggered.nodes_of(p).withColumns({f"i{c}": F.col(c) for c in COORDS})
    nodes = staggered.add_constant(nodes, ["ix"], 1).withColumn("ix", F.when(F.col("x") % 5 == 0, F.col("ix")).otherwise(F.col("ix") - 1))
    return staggered.id_check(nodes, p, ("ix", "iy", "iz"))


@register("g153_level_centre_line", f"WITH {_ML} SELECT level, x / 24::DOUBLE AS pos, (level + x) / 0.5::DOUBLE AS value FROM m WHERE y = 12 AND z = 12")
def _(spark, sf_dir):
    m = levels(spark).withColumn("u", (F.col("level") + F.col("x")).cast("double"))
    return level_flow.centre_line(m, LEVELS, "x", "u", 0.5)


from gridloom import block_queries, level_queries  # noqa: E402, F401  They register their own queries here.


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
