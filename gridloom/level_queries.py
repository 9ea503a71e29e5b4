"""Queries on levels that the orders mark: cells with high prices are refined, so grids and flow follow the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.lbm import multires as flow
from gridloom.lbm.lattice import C19, CENTER, OPPOSITE_19, W19
from gridloom.operators import multires
from gridloom.queries import G, height, orders, register
from gridloom.spec import COORDS, GridSpec

#: Prices in cents from which a place is covered at the finest level, and at the middle one.
FINE, MIDDLE = 49_000_000, 46_000_000
SIDE = 24


def marked(spark: SparkSession, sf_dir: str) -> tuple[GridSpec, DataFrame]:
    """The orders in the largest box of whole coarsest cells, 24 x 24 wide."""
    cells = orders(spark, sf_dir)
    grid = GridSpec(SIDE, SIDE, height(cells) // 4 * 4)
    return grid, cells.filter((F.col("x") < SIDE) & (F.col("y") < SIDE) & (F.col("z") < grid.nz))


def levels(spark: SparkSession, sf_dir: str) -> tuple[GridSpec, DataFrame]:
    """Three levels, balanced: places with high prices fine, those with middle ones at the middle level, everything at the coarsest."""
    grid, cells = marked(spark, sf_dir)
    marks = [cells.filter(F.col("v") >= FINE), cells.filter(F.col("v") >= MIDDLE), cells]
    return grid, multires.build(spark, grid, marks)


_PLACES = f"""{G}, top AS MATERIALIZED (SELECT (max(z) + 1) // 4 * 4 AS nz FROM g), inside AS MATERIALIZED (SELECT x, y, z, v FROM g CROSS JOIN top WHERE x < {SIDE} AND y < {SIDE} AND z < nz)"""
_SIBLINGS = "corner AS MATERIALIZED (SELECT i % 2 AS i, i // 2 % 2 AS j, i // 4 AS k FROM range(8) t(i)), d AS MATERIALIZED (SELECT i % 3 - 1 AS dx, i // 3 % 3 - 1 AS dy, i // 9 - 1 AS dz FROM range(27) t(i))"
#: Marked cells as whole blocks with their ancestors, then what neighbours ask for, until nothing is added; and which cells have children.
_LEVELS = f"""{_PLACES}, {_SIBLINGS},
b0 AS MATERIALIZED (SELECT DISTINCT x - x % 2 AS x, y - y % 2 AS y, z - z % 2 AS z FROM inside WHERE v >= {FINE}),
b1 AS MATERIALIZED (SELECT DISTINCT x - x % 4 AS x, y - y % 4 AS y, z - z % 4 AS z FROM (SELECT x, y, z FROM inside WHERE v >= {MIDDLE} UNION ALL FROM b0)),
given AS MATERIALIZED (SELECT 0 AS level, x + i AS x, y + j AS y, z + k AS z FROM b0, corner UNION SELECT 1, x + 2 * i, y + 2 * j, z + 2 * k FROM b1, corner UNION SELECT 2, x - x % 4, y - y % 4, z - z % 4 FROM inside),
asked AS (SELECT level, x, y, z FROM given UNION SELECT up, px - CASE WHEN up < 2 THEN px % (2 << up) - (i << up) ELSE 0 END, py - CASE WHEN up < 2 THEN py % (2 << up) - (j << up) ELSE 0 END, pz - CASE WHEN up < 2 THEN pz % (2 << up) - (k << up) ELSE 0 END
 FROM (SELECT DISTINCT level + 1 AS up, nx - nx % (2 << level) AS px, ny - ny % (2 << level) AS py, nz - nz % (2 << level) AS pz
  FROM (SELECT level, x + dx * (1 << level) AS nx, y + dy * (1 << level) AS ny, z + dz * (1 << level) AS nz FROM asked, d WHERE level < 2) WHERE nx BETWEEN 0 AND {SIDE - 1} AND ny BETWEEN 0 AND {SIDE - 1} AND nz >= 0 AND nz < (SELECT nz FROM top)), corner),
m AS MATERIALIZED (SELECT a.level, CAST(a.x AS INTEGER) AS x, CAST(a.y AS INTEGER) AS y, CAST(a.z AS INTEGER) AS z, c.level IS NOT NULL AS refined FROM asked a
 LEFT JOIN (SELECT DISTINCT level + 1 AS level, x - x % (2 << level) AS x, y - y % (2 << level) AS y, z - z % (2 << level) AS z FROM asked WHERE level < 2) c USING (level, x, y, z)),
u AS MATERIALIZED (SELECT *, level + 1 AS up, x - x % (2 << level) AS px, y - y % (2 << level) AS py, z - z % (2 << level) AS pz FROM m)"""
_CELL = "CAST(level AS INTEGER) AS level, x, y, z"


@register("g092_balanced_orders", f"WITH RECURSIVE {_LEVELS} SELECT {_CELL}, refined FROM m")
def _(spark, sf_dir):
    return levels(spark, sf_dir)[1]


@register("g091_culled_orders", f"""WITH RECURSIVE {_LEVELS}, r AS MATERIALIZED (SELECT level, x, y, z FROM m WHERE refined),
n AS MATERIALIZED (SELECT level, x, y, z, x + dx * (1 << level) AS nx, y + dy * (1 << level) AS ny, z + dz * (1 << level) AS nz FROM r, d WHERE dx <> 0 OR dy <> 0 OR dz <> 0),
o AS (SELECT DISTINCT n.level, n.x, n.y, n.z FROM n LEFT JOIN r ON r.level = n.level AND r.x = nx AND r.y = ny AND r.z = nz WHERE r.x IS NULL AND nx BETWEEN 0 AND {SIDE - 1} AND ny BETWEEN 0 AND {SIDE - 1} AND nz >= 0 AND nz < (SELECT nz FROM top))
SELECT CAST(m.level AS INTEGER) AS level, m.x, m.y, m.z, refined FROM m LEFT JOIN o USING (level, x, y, z) WHERE NOT (refined AND o.level IS NULL)""")
def _(spark, sf_dir):
    grid, cells = levels(spark, sf_dir)
    return multires.cull(cells, grid)


def _valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels(spark, sf_dir)[1].withColumn("w", (F.col("level") * 1000 + F.col("x") + F.col("y") + F.col("z")).cast("long"))


_W = "level * 1000 + x + y + z"


@register("g095_children_orders", f"WITH RECURSIVE {_LEVELS} SELECT CAST(up AS INTEGER) AS level, px AS x, py AS y, pz AS z, count(*) AS children, CAST(sum({_W}) AS BIGINT) AS child_sum FROM u JOIN (SELECT level AS l, x AS a, y AS b, z AS c FROM m) ON up = l AND px = a AND py = b AND pz = c GROUP BY ALL".replace("px AS x", "CAST(px AS INTEGER) AS x").replace("py AS y", "CAST(py AS INTEGER) AS y").replace("pz AS z", "CAST(pz AS INTEGER) AS z"))
def _(spark, sf_dir):
    return multires.children(_valued(spark, sf_dir), "w").select(*multires.LEVEL_COORDS, "children", "child_sum")


_PARENT = "b.level = a.up AND b.x = a.px AND b.y = a.py AND b.z = a.pz"


@register("g096_parents_orders", f"WITH RECURSIVE {_LEVELS} SELECT CAST(a.level AS INTEGER) AS level, a.x, a.y, a.z, CAST(b.level * 1000 + b.x + b.y + b.z AS BIGINT) AS parent_value, b.level IS NOT NULL AS has_parent FROM u a LEFT JOIN m b ON {_PARENT}")
def _(spark, sf_dir):
    return multires.with_parent(_valued(spark, sf_dir), "w").select(*multires.LEVEL_COORDS, "parent_value", "has_parent")


@register("g146_accumulate_orders", f"WITH RECURSIVE {_LEVELS}, s AS (SELECT up AS level, px AS x, py AS y, pz AS z, sum({_W}) AS s FROM u GROUP BY ALL) SELECT CAST(m.level AS INTEGER) AS level, m.x, m.y, m.z, CAST({_W} + coalesce(s, 0) AS BIGINT) AS w FROM m LEFT JOIN s USING (level, x, y, z)")
def _(spark, sf_dir):
    return multires.accumulate_to_parents(_valued(spark, sf_dir).drop("refined"), "w")


@register("g147_write_children_orders", f"WITH RECURSIVE {_LEVELS} SELECT CAST(a.level AS INTEGER) AS level, a.x, a.y, a.z, CAST(coalesce(b.level * 1000 + b.x + b.y + b.z, a.level * 1000 + a.x + a.y + a.z) AS BIGINT) AS w FROM u a LEFT JOIN m b ON {_PARENT}")
def _(spark, sf_dir):
    return multires.write_children(_valued(spark, sf_dir).drop("refined"), "w")


# Flow on two levels.

LID, OMEGA, LEAST = 0.05, 1.5, 48_500_000
_OFF = "((7 * x + 5 * y + 3 * z + q) % 11) / 100.0"


def fluid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box with a lid, refined where prices are high, its fluid disturbed."""
    grid, cells = marked(spark, sf_dir)
    made = multires.build(spark, grid, [cells.filter(F.col("v") >= LEAST), cells])
    state = flow.at_rest(made, (grid.nx, grid.ny, grid.nz), 2, C19, W19, LID)
    stirred = F.transform("f", lambda v, q: v * (1.0 + ((7 * F.col("x") + 5 * F.col("y") + 3 * F.col("z") + q) % 11) / 100.0))
    return state.withColumn("f", stirred).withColumn("o", F.col("f"))


_RATES = [multires.omega(OMEGA, k, 2) for k in (0, 1)]
_CELLS = f"""{_PLACES}, lat(q, cx, cy, cz, wt, op) AS (VALUES {", ".join(f"({q}, {c[0]}, {c[1]}, {c[2]}, {w!r}::DOUBLE, {o})" for q, (c, w, o) in enumerate(zip(C19, W19, OPPOSITE_19, strict=True)))}),
fine AS MATERIALIZED (SELECT DISTINCT x - x % 2 AS x, y - y % 2 AS y, z - z % 2 AS z FROM inside WHERE v >= {LEAST}),
placed AS MATERIALIZED (SELECT 0 AS level, CAST(x + i AS INTEGER) AS x, CAST(y + j AS INTEGER) AS y, CAST(z + k AS INTEGER) AS z, 1 AS w, false AS refined FROM fine, range(2) a(i), range(2) b(j), range(2) c(k)
 UNION ALL SELECT 1, b.x, b.y, b.z, 2, fine.x IS NOT NULL FROM (SELECT DISTINCT CAST(x - x % 2 AS INTEGER) AS x, CAST(y - y % 2 AS INTEGER) AS y, CAST(z - z % 2 AS INTEGER) AS z FROM inside) b LEFT JOIN fine USING (x, y, z)),
cells AS MATERIALIZED (SELECT *, CASE WHEN NOT face THEN 0 WHEN y + w >= {SIDE} THEN 2 ELSE 1 END AS kind FROM (SELECT *, x = 0 OR y = 0 OR z = 0 OR x + w >= {SIDE} OR y + w >= {SIDE} OR z + w >= (SELECT nz FROM top) AS face FROM placed)),
s0 AS MATERIALIZED (SELECT level, x, y, z, w, refined, kind, q, f, f AS o FROM (SELECT *, CASE WHEN kind = 0 AND NOT refined THEN wt WHEN kind = 2 THEN -6 * wt * {LID} * cx ELSE 0 END * (1 + {_OFF}::DOUBLE) AS f FROM cells CROSS JOIN lat)),
way AS MATERIALIZED (SELECT *, x + CAST(floor((sx - x + x % 2) / 2) AS INTEGER) AS kx, y + CAST(floor((sy - y + y % 2) / 2) AS INTEGER) AS ky, z + CAST(floor((sz - z + z % 2) / 2) AS INTEGER) AS kz
 FROM (SELECT x, y, z, q, cx, cy, cz, CAST(2 * floor((x + cx) / 2) AS INTEGER) - 2 * cx AS sx, CAST(2 * floor((y + cy) / 2) AS INTEGER) - 2 * cy AS sy, CAST(2 * floor((z + cz) / 2) AS INTEGER) - 2 * cz AS sz FROM cells CROSS JOIN lat WHERE level = 0 AND q <> {CENTER})),
sends AS MATERIALIZED (SELECT * FROM way p WHERE NOT EXISTS (FROM cells n WHERE n.level = 0 AND n.x = p.x + p.cx AND n.y = p.y + p.cy AND n.z = p.z + p.cz)
 AND EXISTS (FROM cells n WHERE n.level = 1 AND n.x = p.sx + 2 * p.cx AND n.y = p.sy + 2 * p.cy AND n.z = p.sz + 2 * p.cz) AND EXISTS (FROM cells n WHERE n.level = 1 AND n.x = p.sx AND n.y = p.sy AND n.z = p.sz)),
share AS MATERIALIZED (SELECT sx, sy, sz, q, 1 / (2 * count(*)::DOUBLE) AS weight FROM sends GROUP BY ALL),
left_in AS MATERIALIZED (SELECT s.* FROM sends s WHERE EXISTS (FROM cells n WHERE n.level = 0 AND n.x = s.kx AND n.y = s.ky AND n.z = s.kz))"""


class Script:
    """CTEs that turn one state into the next; self.now is the name of the last."""

    def __init__(self):
        self.sql, self.n = [_CELLS], 0

    @property
    def now(self) -> str:
        return f"s{self.n}"

    def put(self, before: str, body: str) -> None:
        old, self.n = self.now, self.n + 1
        self.sql.append(before.replace("@", old).replace("#", str(self.n)) + f"{self.now} AS MATERIALIZED ({body})".replace("@", old).replace("#", str(self.n)))

    def collide(self, level: int) -> None:
        rate = f"{_RATES[level]!r}::DOUBLE"
        self.put(
            f"m# AS MATERIALIZED (SELECT level, x, y, z, sum(f) AS rho, sum(f * cx) / sum(f) AS ux, sum(f * cy) / sum(f) AS uy, sum(f * cz) / sum(f) AS uz FROM @ JOIN lat USING (q) WHERE level = {level} AND kind = 0 AND NOT refined GROUP BY ALL),\n",
            f"""SELECT level, x, y, z, w, refined, kind, q, f, CASE WHEN rho IS NOT NULL THEN (1 - {rate}) * f + {rate} * rho * wt * (1 + 3 * cu + 4.5 * cu * cu - 1.5 * (ux * ux + uy * uy + uz * uz)) WHEN level = {level} AND kind = 0 AND refined AND {level} > 0 THEN 0 ELSE o END AS o
 FROM (SELECT s.*, wt, rho, ux, uy, uz, cx * ux + cy * uy + cz * uz AS cu FROM @ s JOIN lat USING (q) LEFT JOIN m# USING (level, x, y, z))""",
        )

    def store(self) -> None:
        self.put(
            "a# AS MATERIALIZED (SELECT sx, sy, sz, q, sum(o) AS v FROM left_in JOIN (FROM @ WHERE level = 0) USING (x, y, z, q) GROUP BY ALL),\n",
            "SELECT s.* REPLACE (o + CASE WHEN s.level = 1 THEN coalesce(a#.v, 0) ELSE 0 END AS o) FROM @ s LEFT JOIN a# ON a#.sx = s.x AND a#.sy = s.y AND a#.sz = s.z AND a#.q = s.q",
        )

    def stream(self, level: int) -> None:
        cover = ", ".join(f"CAST(floor((s.{c} - l.c{c} * s.w) / (2.0 * s.w)) AS INTEGER) * 2 * s.w AS u{c}, CAST(s.{c} - s.{c} % (2 * s.w) AS INTEGER) AS e{c}" for c in COORDS)
        self.put(
            f"""v# AS MATERIALIZED (SELECT s.x, s.y, s.z, s.q, l.op, s.kind, {", ".join(f"s.{c} - l.c{c} * s.w AS p{c}" for c in COORDS)}, {cover} FROM @ s JOIN lat l USING (q) WHERE level = {level} AND NOT refined AND q <> {CENTER}),
l# AS MATERIALIZED (FROM @ WHERE level = {level}), h# AS MATERIALIZED (FROM @ WHERE level = {level + 1}),
w# AS MATERIALIZED (SELECT v.x, v.y, v.z, v.q, CASE WHEN a.x IS NOT NULL AND a.refined THEN a.o * coalesce(share.weight, 0) WHEN a.x IS NOT NULL AND v.kind = 0 AND a.kind = 0 THEN a.o WHEN a.x IS NOT NULL AND v.kind = 0 THEN own.o + b.o WHEN a.x IS NULL AND e.x IS NOT NULL THEN c.o END AS value
 FROM v# v LEFT JOIN l# a ON a.x = v.px AND a.y = v.py AND a.z = v.pz AND a.q = v.q LEFT JOIN l# b ON b.x = v.px AND b.y = v.py AND b.z = v.pz AND b.q = v.op JOIN l# own ON own.x = v.x AND own.y = v.y AND own.z = v.z AND own.q = v.op
 LEFT JOIN share ON {level} = 1 AND share.sx = v.px AND share.sy = v.py AND share.sz = v.pz AND share.q = v.q
 LEFT JOIN h# c ON c.x = v.ux AND c.y = v.uy AND c.z = v.uz AND c.q = v.q LEFT JOIN h# e ON e.x = v.ex AND e.y = v.ey AND e.z = v.ez AND e.q = v.q),\n""",
            f"SELECT s.* REPLACE (CASE WHEN s.level <> {level} OR refined THEN f WHEN s.q = {CENTER} THEN CASE WHEN kind = 0 THEN o ELSE f END ELSE coalesce(w#.value, f) END AS f) FROM @ s LEFT JOIN w# ON s.level = {level} AND w#.x = s.x AND w#.y = s.y AND w#.z = s.z AND w#.q = s.q",
        )

    def step(self) -> None:
        self.collide(1)
        for _ in range(2):
            self.collide(0)
            self.store()
            self.stream(0)
        self.stream(1)

    def query(self) -> str:
        return "WITH " + ",\n".join(self.sql) + f"\nSELECT CAST(level AS INTEGER) AS level, x, y, z, q, round(f, 9) + 0.0::DOUBLE AS f FROM {self.now} WHERE NOT refined"


def _streams() -> str:
    script = Script()
    script.stream(0)
    script.stream(1)
    return script.query()


def _steps(n: int) -> str:
    script = Script()
    for _ in range(n):
        script.step()
    return script.query()


def populations(cells: DataFrame) -> DataFrame:
    rows = cells.filter("NOT refined").select(*multires.LEVEL_COORDS, F.posexplode("f").alias("q", "f"))
    return rows.withColumn("f", F.round("f", 9) + 0.0)


@register("g119_level_streams_orders", _streams())
def level_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming of both levels, with explosion and coalescence."""
    return populations(reduce(lambda cells, level: flow.stream(cells, level, C19), (0, 1), fluid(spark, sf_dir)))


@register("g121_nonuniform_steps_orders", _steps(2))
def nonuniform_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The populations of two steps of the coarse level, four of the fine one."""
    return populations(reduce(lambda cells, _: flow.advance(cells, 1, 2, OMEGA, C19, W19), range(2), fluid(spark, sf_dir)))
