"""Queries on packed block tables, and others whose grids come from the tables and grow with them."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.lbm import uniform
from gridloom.lbm.lattice import C19, OPPOSITE_19, W19
from gridloom.operators import connectivity, packed
from gridloom.queries import BOX, G, S6, SPARSE, _RING, around, folded, height, orders, register, sparse, values
from gridloom.solver import cg
from gridloom.plans.checkpoint import shared_folder
from gridloom.sources import mesh, pieces
from gridloom.spec import COORDS, GridSpec


@register("g003_packed_table", f"""WITH {SPARSE} SELECT CAST(x // 8 AS INTEGER) AS bx, CAST(y // 8 AS INTEGER) AS "by", CAST(z // 8 AS INTEGER) AS bz, count(*) AS active, CAST(sum(v) AS BIGINT) AS v, CAST(sum(w * (x % 8 + y % 8 * 8 + z % 8 * 64)) AS BIGINT) AS w FROM s GROUP BY ALL""")
def _(spark, sf_dir):
    """Per block the bits set, the sum of one array, and the other's dot product with the places in it."""
    table = packed.pack(sparse(spark, sf_dir), ["v", "w"])
    summed = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b)
    placed = F.transform("w", lambda w, k: w * k)
    return table.frame().select(*packed.BLOCK, packed.count_bits("active").alias("active"), summed("v").alias("v"), summed(placed).alias("w"))


@register("g049_laplace_count_packed", f"WITH {SPARSE}, {around(S6, 's')} {folded('s', S6, 'v - n * t')}")
def _(spark, sf_dir):
    table = packed.pack(sparse(spark, sf_dir).select(*COORDS, "v"), ["v"])
    return packed.unpack(packed.step(table, packed.laplace_count("v"), table.fields, ["v"])).withColumnRenamed("v", "value")


@register("g050_laplace_matvec_packed", f"WITH {G}, {around(S6, 'g', 'c.v, c.w')} SELECT x, y, z, CASE WHEN b = 0 THEN v::DOUBLE ELSE (n * v - t)::DOUBLE / 0.25 END AS value FROM (SELECT x, y, z, any_value(v) AS v, any_value(w) % 4 AS b, CAST(coalesce(sum(nv), 0) AS BIGINT) AS t, count(nv) AS n FROM nb GROUP BY x, y, z)")
def _(spark, sf_dir):
    table = packed.pack(orders(spark, sf_dir).withColumn("bd", F.col("w") % 4), ["v", "bd"])
    made = packed.step(table, packed.laplace_matvec("v", "bd", "value", 0.5), [packed.Field("value", "double")], ["v"], own=["bd"])
    return packed.unpack(made)


@register("g051_gradient_packed", f"WITH {SPARSE}, {around(packed.AXES, 's')} SELECT x, y, z, " + ", ".join(f"CASE WHEN count(nv) = 6 THEN (max(nv) FILTER (slot = {2 * k}) - max(nv) FILTER (slot = {2 * k + 1}))::DOUBLE / 2 ELSE 0 END AS g{c}" for k, c in enumerate(COORDS)) + " FROM nb GROUP BY x, y, z")
def _(spark, sf_dir):
    table = packed.pack(sparse(spark, sf_dir).select(*COORDS, "v"), ["v"])
    made = packed.step(table, packed.gradient("v", "g"), [packed.Field("g", "double", 3)], ["v"])
    return packed.unpack(made).select(*COORDS, *[F.col("g")[k].alias(f"g{c}") for k, c in enumerate(COORDS)])


@register("g052_life_packed", f"WITH {G}, l AS (SELECT x, y, z, CASE WHEN v % 3 = 0 THEN 1 ELSE 0 END AS v FROM g), {around(_RING, 'l')} {folded('l', _RING, 'CASE WHEN t = 3 OR (t = 2 AND v > 0) THEN 1 ELSE 0 END')}")
def _(spark, sf_dir):
    cells = orders(spark, sf_dir).select(*COORDS, (F.col("v") % 3 == 0).cast("int").alias("v"))
    table = packed.pack(cells, ["v"])
    return packed.unpack(packed.step(table, packed.life("v"), table.fields, ["v"], _RING)).withColumnRenamed("v", "value")


_ROUND = "p{1} AS MATERIALIZED (SELECT x, y, z, CAST((any_value(v) - count(nv) * coalesce(sum(nv), 0)) % 1000 AS BIGINT) AS v FROM (SELECT c.x, c.y, c.z, c.v, n.v AS nv FROM p{0} c CROSS JOIN off o LEFT JOIN p{0} n ON n.x = c.x + o.dx AND n.y = c.y + o.dy AND n.z = c.z + o.dz) GROUP BY x, y, z)"


@register("g141_laplace_iterated_packed", f"WITH {SPARSE}, {values(S6)}, p0 AS MATERIALIZED (SELECT x, y, z, v FROM s), {', '.join(_ROUND.format(k, k + 1) for k in range(5))} SELECT x, y, z, v FROM p5")
def laplace_iterated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rounds over all orders that are left, on a packed table: only faces move."""
    table = packed.pack(sparse(spark, sf_dir).select(*COORDS, "v"), ["v"])
    laplace = packed.laplace_count("v")
    return packed.unpack(packed.iterate(table, 5, lambda h: {"v": np.fmod(laplace(h)["v"], 1000)}, table.fields, ["v"]))


_HEAD = """'<?xml version="1.0"?>' || chr(10) || '<VTKFile type="ImageData" version="0.1" byte_order="LittleEndian">' || chr(10) || '<ImageData WholeExtent="0 25 0 25 0 ' || any_value(nz) || '" Origin="0 0 0" Spacing="1 1 1">' || chr(10) || '<Piece Extent="0 25 0 25 ' || 8 * piece || ' ' || least(8 * piece + 8, any_value(nz)) || '">' || chr(10) || '<CellData>' || chr(10)"""
_ARRAY = """'<DataArray type="Float64" Name="{0}" NumberOfComponents="{1}" format="ascii">' || chr(10) || string_agg({2} || chr(10), '' ORDER BY i) || '</DataArray>' || chr(10)"""


@register("g014_image_pieces", f"WITH {G}, top AS (SELECT max(z) + 1 AS nz FROM g), c AS (SELECT i, CAST(i % 25 AS INTEGER) AS x, CAST(i // 25 % 25 AS INTEGER) AS y, CAST(i // 625 AS INTEGER) AS z, nz FROM top, range(nz * 625) t(i)), p AS (SELECT CAST(c.z // 8 AS INTEGER) AS piece, c.i, nz, coalesce(CAST(v AS VARCHAR), '-1') AS v, coalesce(CAST(w AS VARCHAR), '-1') AS w FROM c LEFT JOIN g USING (x, y, z)) SELECT piece, md5({_HEAD} || {_ARRAY.format('v', 1, 'v')} || {_ARRAY.format('pair', 2, chr(118) + " || ' ' || w")} || '</CellData>' || chr(10) || '</Piece>' || chr(10) || '</ImageData>' || chr(10) || '</VTKFile>' || chr(10)) AS digest FROM p GROUP BY piece")
def image_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as an image in pieces of eight planes, read back."""
    cells = orders(spark, sf_dir)
    folder = f"{shared_folder(spark)}/image-{uuid.uuid4().hex}"
    pieces.write_pieces(folder, cells, GridSpec(25, 25, height(cells)), {"v": ["v"], "pair": ["v", "w"]}, 8, -1.0)
    return pieces.read_pieces(spark, folder).select("piece", F.md5("content").alias("digest"))


_OUT = " + ".join(f"pow(greatest(abs({c} - 10.3) - 6.0, 0), 2)" for c in "xyz")


@register("g020_mesh_orders", f"WITH {G} SELECT x, y, z, greatest(abs(x - 10.3), abs(y - 10.3), abs(z - 10.3)) < 6 AS inside, round(CASE WHEN greatest(abs(x - 10.3), abs(y - 10.3), abs(z - 10.3)) < 6 THEN 6 - greatest(abs(x - 10.3), abs(y - 10.3), abs(z - 10.3)) ELSE sqrt({_OUT}) END::DOUBLE, 6) + 0.0::DOUBLE AS distance FROM g")
def mesh_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders against a cube of triangles, each face a net of sixteen squares."""
    points, faces = mesh.net(4)
    rows = mesh.with_mesh(orders(spark, sf_dir), mesh.fit(points, (10.3, 10.3, 10.3), 12.0), faces)
    return rows.withColumn("distance", F.round("distance", 6) + 0.0)


_FREE = "w % 3 = 1 AND z > 0 AND z < top"


@register("g125_poisson_orders", f"WITH {G} SELECT x, y, z, CASE WHEN {_FREE} THEN 0.0::DOUBLE ELSE (v % 40 - 20)::DOUBLE END AS value FROM g CROSS JOIN (SELECT max(z) AS top FROM g)")
def poisson_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poisson's problem on all orders; plates at both ends and cells of some customers are fixed. What is left of the equation in free cells, u in fixed ones.

    Blocks are as wide as the box, so none is padded and faces lie above and below alone.
    """
    cells = orders(spark, sf_dir)
    top, count = cells.agg(F.coalesce(F.max("z"), F.lit(-1)), F.count(F.lit(1))).first()
    free = F.expr(_FREE.replace("top", str(top)))
    field = cells.select(*COORDS, F.when(free, 0.0).otherwise(F.col("v") % 40 - 20).cast("double").alias("u"), (F.col("v") % 7 - 3).cast("double").alias("b"), free.cast("int").alias("boundary"))
    solved, end = cg.solve_packed(field, parameters=cg.Parameters(relative=1e-9), size=BOX.nx, buckets=packed.buckets_for(spark, count))
    if end.status != "converged":
        raise RuntimeError(f"the solver ended with {end}")
    left = packed.step(solved, packed.laplace_matvec("u", "bd", "value"), [packed.Field("value", "double")], ["u"], keep=["bd", "b"], own=["bd"])
    solved.drop()
    return packed.unpack(left).select(*COORDS, (F.when(F.col("bd") == 1, F.round(F.col("value") - F.col("b"), 5)).otherwise(F.col("value")) + 0.0).alias("value"))


@register("g087_stored_neighbours", f"WITH {SPARSE}, {values(S6)} SELECT n.x, n.y, n.z, CAST(o.slot AS INTEGER) AS slot, c.x AS nx, c.y AS ny, c.z AS nz FROM s n CROSS JOIN off o JOIN s c ON c.x = n.x + o.dx AND c.y = n.y + o.dy AND c.z = n.z + o.dz")
def _(spark, sf_dir):
    """The neighbour table of the orders that are left."""
    return spark.table(connectivity.connect(sparse(spark, sf_dir), S6).table).drop(*connectivity.BLOCK)


@register("g045_gathers_in_a_row", f"WITH {SPARSE}, {values(S6)}, p0 AS MATERIALIZED (SELECT x, y, z, v FROM s), {', '.join(_ROUND.format(k, k + 1) for k in range(3))} SELECT x, y, z, v FROM p3")
def gathers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stencils in a row over a stored neighbour table."""
    field = sparse(spark, sf_dir)
    conn = connectivity.connect(field, S6, 3)
    return connectivity.run(conn, field, "v", [lambda v, total, n: (v - n * total) % 1000] * 3)


def box_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed box as high as the orders reach: its lid at the last y, its fluid disturbed by the prices."""
    cells = orders(spark, sf_dir)
    nz = height(cells)
    edge = (F.col("x") % 24 == 0) | (F.col("y") % 24 == 0) | (F.col("z") == 0) | (F.col("z") >= nz - 1)
    lid = F.col("y") == 24
    kind = F.when(~edge, uniform.BULK).when(lid, uniform.MOVING_WALL).otherwise(uniform.BOUNCE_BACK)
    f = [F.when(~edge, F.lit(t) * (1.0 + (F.col("v") * (q + 3) % 11) / 100.0)).when(lid, -6.0 * t * 0.05 * d[0]).otherwise(0.0) for q, (t, d) in enumerate(zip(W19, C19, strict=True))]
    return uniform.wall_mask(cells.select(*COORDS, kind.alias("kind"), F.array(*f).alias("f")))


_OMEGA = 1.4
_BOX = f"""{G}, lat(q, cx, cy, cz, wt, op) AS (VALUES {", ".join(f"({q}, {c[0]}, {c[1]}, {c[2]}, {w!r}::DOUBLE, {o})" for q, (c, w, o) in enumerate(zip(C19, W19, OPPOSITE_19, strict=True)))}),
cells AS MATERIALIZED (SELECT x, y, z, v, CASE WHEN x % 24 <> 0 AND y % 24 <> 0 AND z > 0 AND z < top THEN 0 WHEN y = 24 THEN 2 ELSE 1 END AS kind FROM g CROSS JOIN (SELECT max(z) AS top FROM g)),
f0 AS MATERIALIZED (SELECT x, y, z, kind, q, CASE kind WHEN 0 THEN wt * (1 + (v * (q + 3) % 11) / 100.0::DOUBLE) WHEN 2 THEN -6.0 * wt * 0.05 * cx ELSE 0.0 END AS f FROM cells CROSS JOIN lat)"""


def box_steps(steps: int) -> str:
    """CTEs f1, f2, ... of the box's populations."""
    out = _BOX
    for k in range(steps):
        out += f""",
src{k} AS MATERIALIZED (SELECT f.x, f.y, f.z, f.q, f.f, b.f AS b, f.kind FROM f{k} f JOIN lat USING (q) JOIN f{k} b ON b.x = f.x AND b.y = f.y AND b.z = f.z AND b.q = lat.op),
moved{k} AS MATERIALIZED (SELECT s.x + l.cx AS x, s.y + l.cy AS y, s.z + l.cz AS z, s.q, s.f AS a, s.b AS b, s.kind AS from_kind FROM src{k} s JOIN lat l USING (q)),
pulled{k} AS MATERIALIZED (SELECT o.x, o.y, o.z, o.q, l.cx, l.cy, l.cz, l.wt, CASE WHEN o.q = 9 THEN o.f WHEN m.from_kind = 0 THEN m.a ELSE o.b + coalesce(m.b, 0) END AS g
 FROM src{k} o JOIN lat l USING (q) LEFT JOIN moved{k} m ON m.x = o.x AND m.y = o.y AND m.z = o.z AND m.q = o.q WHERE o.kind = 0),
mom{k} AS MATERIALIZED (SELECT x, y, z, sum(g) AS rho, sum(g * cx) / sum(g) AS ux, sum(g * cy) / sum(g) AS uy, sum(g * cz) / sum(g) AS uz FROM pulled{k} GROUP BY x, y, z),
f{k + 1} AS MATERIALIZED (SELECT x, y, z, 0 AS kind, q, {1 - _OMEGA!r}::DOUBLE * g + {_OMEGA!r}::DOUBLE * rho * wt * (1 + 3 * cu + 4.5 * cu * cu - 1.5 * (ux * ux + uy * uy + uz * uz)) AS f
 FROM (SELECT p.*, rho, ux, uy, uz, cx * ux + cy * uy + cz * uz AS cu FROM pulled{k} p JOIN mom{k} USING (x, y, z)) UNION ALL SELECT x, y, z, kind, q, f FROM f{k} WHERE kind <> 0)"""
    return out


@register("g109_lbm_steps_packed", f"WITH {box_steps(2)} SELECT x, y, z, q, round(f, 9) + 0.0::DOUBLE AS f FROM f2")
def lbm_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps of flow in the box of orders, on a packed table."""
    table = uniform.run_packed(uniform.pack(box_of_orders(spark, sf_dir)), _OMEGA, 2)
    return packed.unpack(table, ["f"]).select(*COORDS, F.posexplode("f").alias("q", "f")).withColumn("f", F.round("f", 9) + 0.0)
