"""Multi-resolution grids: cells of several levels, level 0 the finest, with origins in finest units.

A cell of level l is 2^l wide. Its parent's origin is its own, rounded down to a multiple of 2^(l+1).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.checkpoint import PLACES, bucketed
from gridloom.operators.stencils import gather
from gridloom.sources.cells import dense
from gridloom.spec import COORDS, S6, S27, GridSpec, Stencil

LEVEL_COORDS = ("level", *COORDS)
#: What an operator on one level may read: its own cells, their neighbours too, their parents, or their children.
MAP, STENCIL, STENCIL_UP, STENCIL_DOWN = "map", "stencil", "stencil_up", "stencil_down"


def width(level: Column | str = "level") -> Column:
    level = F.col(level) if isinstance(level, str) else level
    return F.call_function("shiftleft", F.lit(1), level).cast("int")


def parent_coords(level: Column | str = "level") -> list[Column]:
    """level, x, y, z of the parent, as p_level, p_x, p_y, p_z."""
    level = F.col(level) if isinstance(level, str) else level
    w = width(level + 1)
    return [(level + 1).alias("p_level"), *[(F.floor(F.col(c) / w) * w).cast("int").alias(f"p_{c}") for c in COORDS]]


def local_index(level: Column | str = "level") -> Column:
    """Which of its parent's eight children a cell is: i + 2 j + 4 k."""
    w = width(level)
    i, j, k = ((F.floor(F.col(c) / w) % 2).cast("int") for c in COORDS)
    return i + 2 * j + 4 * k


def build(spark: SparkSession, grid: GridSpec, active: Sequence[Column | DataFrame], balanced: bool = True, culled: bool = False) -> DataFrame:
    """level, x, y, z, refined. active: for each level a predicate on x, y, z, or a frame with the places that are to be covered at this level.

    A level's active cells are completed to whole blocks of eight, and each block's parent becomes active.
    """
    levels: list[DataFrame] = []
    parents: DataFrame | None = None
    for level, predicate in enumerate(active):
        w = 1 << level
        box = GridSpec(-(-grid.nx // w), -(-grid.ny // w), -(-grid.nz // w))
        if isinstance(predicate, DataFrame):
            own = predicate.select(*[(F.floor(F.col(c) / w) * w).cast("int").alias(c) for c in COORDS]).distinct()
        else:
            own = dense(spark, box).select(*[(F.col(c) * w).alias(c) for c in COORDS]).filter(predicate)
        if parents is not None:
            own = own.unionByName(parents)
        blocks = own.select(*[(F.floor(F.col(c) / (2 * w)) * (2 * w)).cast("int").alias(c) for c in COORDS]).distinct()
        top = level == len(active) - 1
        whole = own.distinct() if top else complete(blocks, w)
        inside = [F.col(c) < n for c, n in zip(COORDS, (grid.nx, grid.ny, grid.nz), strict=True)]
        levels.append(whole.filter(inside[0] & inside[1] & inside[2]).select(F.lit(level).alias("level"), *COORDS))
        parents = None if top else blocks
    cells = reduce(DataFrame.unionByName, levels)
    if balanced:
        cells = balance(cells, grid, len(active))
    cells = with_refined(cells)
    return cull(cells, grid) if culled else cells


def complete(blocks: DataFrame, w: int) -> DataFrame:
    corners = F.array(*[F.struct(*[F.lit(v * w).alias(f"d{c}") for v, c in zip(o, COORDS, strict=True)]) for o in ((i, j, k) for k in (0, 1) for j in (0, 1) for i in (0, 1))])
    rows = blocks.select(*COORDS, F.explode(corners).alias("o"))
    return rows.select(*[(F.col(c) + F.col(f"o.d{c}")).alias(c) for c in COORDS])


def with_refined(cells: DataFrame) -> DataFrame:
    """refined: whether a cell has children."""
    parents = cells.select(*parent_coords()).distinct().select(F.col("p_level").alias("level"), *[F.col(f"p_{c}").alias(c) for c in COORDS], F.lit(True).alias("_r"))
    return cells.join(parents.hint("merge"), list(LEVEL_COORDS), "left").withColumn("refined", F.coalesce("_r", F.lit(False))).drop("_r")


def balance(cells: DataFrame, grid: GridSpec, depth: int, rounds: int = 64, trace: list[int] | None = None) -> DataFrame:
    """Adds blocks until neighbours differ by one level at most.

    Every cell asks that the parents of its 26 neighbours exist one level up; what is missing is added with its siblings and ancestors. What
    a cell asks for depends on that cell alone, so in each round only the cells added last ask. Each round's cells are a bucketed table, and what
    is asked for is held against all of them where they lie: one exchange a round, of what the last cells ask for. What is given back is read from the
    files of all rounds at once: a union of bucketed tables passes for bucketed, but has the partitions of all of them. trace: gets the number of
    cells that asked in each round. An empty grid stays so.
    """
    spark = cells.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    corners = F.array(*[F.struct(*[F.lit(v).alias(f"d{c}") for v, c in zip(o, COORDS, strict=True)]) for o in ((i, j, k) for k in (0, 1) for j in (0, 1) for i in (0, 1))])
    around = F.array(*[F.struct(*[F.lit(v).alias(f"d{c}") for v, c in zip(o, COORDS, strict=True)]) for o in S27])
    box = reduce(lambda a, b: a & b, [(F.col(c) >= 0) & (F.col(c) < size) for c, size in zip(COORDS, (grid.nx, grid.ny, grid.nz), strict=True)])
    parts: list[str] = []

    def added(new: DataFrame) -> int:
        """Writes the cells that no part has, and counts them in the same job."""
        seen = Observation()
        new = new.select(*LEVEL_COORDS).repartition(n, *LEVEL_COORDS).distinct()
        for part in parts:
            new = new.join(spark.table(part).hint("merge"), list(LEVEL_COORDS), "left_anti")
        parts.append(bucketed(new.observe(seen, F.count(F.lit(1)).alias("n")), "levels", n, *LEVEL_COORDS))
        return seen.get["n"]

    count = added(cells)
    for _ in range(rounds):
        if not count:
            return spark.read.schema(spark.table(parts[0]).schema).parquet(*[PLACES[part] for part in parts])
        if trace is not None:
            trace.append(count)
        near = spark.table(parts[-1]).filter(F.col("level") < depth - 1).select("level", *COORDS, F.explode(around).alias("o"))
        near = near.select("level", *[(F.col(c) + F.col(f"o.d{c}") * width()).cast("int").alias(c) for c in COORDS])
        asked = near.filter(box).select(*parent_coords()).distinct().select(F.col("p_level").alias("level"), *[F.col(f"p_{c}").alias(c) for c in COORDS])
        # What is asked for at a level below the top comes as a whole block.
        span = width(F.col("level") + 1)
        blocks = asked.filter(F.col("level") < depth - 1).select("level", *[(F.floor(F.col(c) / span) * span).cast("int").alias(c) for c in COORDS]).distinct()
        filled = blocks.select("level", *COORDS, F.explode(corners).alias("o")).select("level", *[(F.col(c) + F.col(f"o.d{c}") * width()).cast("int").alias(c) for c in COORDS]).filter(box)
        count = added(asked.filter(F.col("level") == depth - 1).unionByName(filled))
    raise RuntimeError("no balance after all rounds")


def cull(cells: DataFrame, grid: GridSpec) -> DataFrame:
    """Drops a refined cell all of whose neighbours in the box are refined too.

    Refined cells tell their neighbours so, and these count; counts are summed up before the shuffle. A cell is closed if as many told it as the box has cells around it.
    """
    around = F.array(*[F.struct(*[F.lit(v).alias(f"d{c}") for v, c in zip(o, COORDS, strict=True)]) for o in S27.without_center()])
    w = width()
    refined = cells.filter("refined").select(*LEVEL_COORDS)
    told = refined.select("level", *COORDS, F.explode(around).alias("o")).select("level", *[(F.col(c) + F.col(f"o.d{c}") * w).cast("int").alias(c) for c in COORDS])
    told = told.groupBy(*LEVEL_COORDS).agg(F.count(F.lit(1)).alias("_told"))
    places = reduce(lambda a, b: a * b, [1 + (F.col(c) - w >= 0).cast("int") + (F.col(c) + w < n).cast("int") for c, n in zip(COORDS, (grid.nx, grid.ny, grid.nz), strict=True)])
    closed = refined.join(told.hint("merge"), list(LEVEL_COORDS), "left").filter(F.coalesce("_told", F.lit(0)) == places - 1).select(*LEVEL_COORDS)
    return cells.join(closed.hint("merge"), list(LEVEL_COORDS), "left_anti")


def with_parent(cells: DataFrame, column: str, shift: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Adds parent_value and has_parent; with a shift, the uncle in that direction of the parent."""
    moved = cells.select("*", *parent_coords())
    for c, d in zip(COORDS, shift, strict=True):
        if d:
            moved = moved.withColumn(f"p_{c}", (F.col(f"p_{c}") + d * width("p_level")).cast("int"))
    up = cells.select(F.col("level").alias("p_level"), *[F.col(c).alias(f"p_{c}") for c in COORDS], F.col(column).alias("parent_value"), F.lit(True).alias("_p"))
    joined = moved.join(up, ["p_level", *[f"p_{c}" for c in COORDS]], "left").withColumn("has_parent", F.coalesce("_p", F.lit(False)))
    return joined.drop("_p", "p_level", *[f"p_{c}" for c in COORDS])


def children(cells: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """Per cell that has some (with how="left": all cells): its children's number, sum and values by local index."""
    down = cells.select(*parent_coords(), local_index().alias("i"), F.col(column).alias("v"))
    kids = down.groupBy("p_level", *[f"p_{c}" for c in COORDS]).agg(F.count(F.lit(1)).alias("children"), F.sum("v").alias("child_sum"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("i", "v")))).alias("child_values"))
    kids = kids.select(F.col("p_level").alias("level"), *[F.col(f"p_{c}").alias(c) for c in COORDS], "children", "child_sum", "child_values")
    return cells.join(kids, list(LEVEL_COORDS), how)


def accumulate_to_parents(cells: DataFrame, column: str) -> DataFrame:
    """parent += sum of its children, one level up from each level."""
    sums = cells.select(*parent_coords(), F.col(column).alias("_v")).groupBy("p_level", *[f"p_{c}" for c in COORDS]).agg(F.sum("_v").alias("_s"))
    sums = sums.select(F.col("p_level").alias("level"), *[F.col(f"p_{c}").alias(c) for c in COORDS], "_s")
    return cells.join(sums, list(LEVEL_COORDS), "left").withColumn(column, F.col(column) + F.coalesce("_s", F.lit(0))).drop("_s")


def write_children(cells: DataFrame, column: str) -> DataFrame:
    """Every cell with a parent takes its parent's value."""
    rows = with_parent(cells, column)
    return rows.withColumn(column, F.when(F.col("has_parent"), F.col("parent_value")).otherwise(F.col(column))).drop("parent_value", "has_parent")


def new_field(cells: DataFrame, values: Sequence[Column | float], name: str = "c") -> DataFrame:
    """A field with a value of its own for each level, finest first; a level without one is null."""
    value = F.lit(None)
    for level, v in enumerate(values):
        value = F.when(F.col("level") == level, v).otherwise(value)
    return cells.withColumn(name, value)


def load(cells: DataFrame, level: int, depth: int, column: str, mode: str = MAP, stencil: Stencil = S6) -> DataFrame:
    """One level's cells with what the mode lets them read of a column.

    MAP: their own columns. STENCIL: also n<k>_<column> and valid<k> for each neighbour k of the level. STENCIL_UP: also
    parent_value and has_parent; the coarsest level has none to read. STENCIL_DOWN: also children, child_sum and
    child_values, null in cells that aren't refined; the finest level has none.
    """
    if not 0 <= level < depth:
        raise ValueError(f"no such level: {level}")
    if mode == MAP:
        return cells.filter(F.col("level") == level)
    if mode == STENCIL:
        own = cells.filter(F.col("level") == level)
        return gather(own, stencil, [column], ["level"], 1 << level, [c for c in cells.columns if c not in (*LEVEL_COORDS, column)])
    if mode == STENCIL_UP:
        if level == depth - 1:
            raise ValueError("the coarsest level has no parents")
        return with_parent(cells.filter(F.col("level").isin(level, level + 1)), column).filter(F.col("level") == level)
    if mode == STENCIL_DOWN:
        if level == 0:
            raise ValueError("the finest level has no children")
        return children(cells.filter(F.col("level").isin(level - 1, level)), column, "left").filter(F.col("level") == level)
    raise ValueError(f"unknown load mode: {mode}")


def on_level(cells: DataFrame, level: int, depth: int, reads: str, writes: str, value: Callable[[DataFrame], Column], mode: str = MAP, stencil: Stencil = S6) -> DataFrame:
    """All cells, with `writes` of one level set from what the mode loads of `reads`; other levels keep theirs.

    A stencil can't write the column that it reads.
    """
    if mode == STENCIL and reads == writes:
        raise ValueError("a stencil can't write the field that it reads")
    loaded = load(cells, level, depth, reads, mode, stencil)
    changed = loaded.withColumn(writes, value(loaded)).select(*dict.fromkeys([*cells.columns, writes]))
    return cells.filter(F.col("level") != level).unionByName(changed, allowMissingColumns=True)


def uncle_offset(i: int, q: int) -> int:
    s = i + q
    return s if s <= 0 else s - 1


def omega(omega0: float, level: int, levels: int) -> float:
    """The relaxation rate of a level, from that of the coarsest."""
    k = levels - level - 1
    return 2 * omega0 / (2 ** (k + 1) + (1 - 2**k) * omega0)
