"""Stored connectivity: which cell reads which, as a table bucketed by block, so that repeated gathers join where the data lie.

A block holds its own cells and those around it that a number of stencils in a row need (`depth` times the radius). The neighbour table has a row
for each cell of a block and neighbour of it; a field is dealt to blocks in the same way, once. A stencil then joins the two
by block and place, and folds by block and reader: no exchange, since both are bucketed by block. Each stencil in a row leaves one radius
fewer of the cells around, and the last one the block's own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.halo import deal
from gridloom.operators.stencils import CENTER, scatter
from gridloom.plans.checkpoint import bucketed, discard, setting
from gridloom.spec import COORDS, Stencil

BLOCK = ("bx", "by", "bz")
SIZE = 16
#: What a join of tables that are bucketed by some of its keys needs, to leave them where they are.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
#: (the cell's value, the sum over its neighbours, their number) -> the new value.
Fold = Callable[[Column, Column, Column], Column]


@dataclass(frozen=True)
class Connectivity:
    """A neighbour table under a name of the session's catalog: bx, by, bz, x, y, z, slot, nx, ny, nz."""

    table: str
    stencil: Stencil
    size: int
    depth: int
    buckets: int


def within(size: int, reach: int) -> Column:
    """Whether a cell lies in its block or within reach of it."""
    near = [(F.col(c) >= F.col(b) * size - reach) & (F.col(c) < (F.col(b) + 1) * size + reach) for c, b in zip(COORDS, BLOCK, strict=True)]
    return reduce(lambda a, b: a & b, near)


def dealt(field: DataFrame, conn_size: int, reach: int, buckets: int) -> DataFrame:
    return deal(field, conn_size, reach).repartition(buckets, *BLOCK)


def connect(cells: DataFrame, stencil: Stencil, depth: int = 1, size: int = SIZE, buckets: int | None = None) -> Connectivity:
    """The neighbour table of cells(x, y, z) for `depth` stencils in a row. One exchange of the cells; an empty grid makes an empty table."""
    spark = cells.sparkSession
    n, reach = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), stencil.radius() * depth
    own = dealt(cells.select(*COORDS), size, reach, n).select(*BLOCK, *COORDS, *[F.col(c).alias(f"n{c}") for c in COORDS])
    sent = scatter(own, stencil, ["nx", "ny", "nz"], BLOCK).filter(within(size, reach - stencil.radius()))
    # A reader that doesn't exist never gets its own row.
    there = F.max((F.col("slot") == CENTER).cast("int")).over(W.partitionBy(*BLOCK, *COORDS))
    rows = sent.withColumn("_there", there).filter((F.col("_there") == 1) & (F.col("slot") != CENTER)).drop("_there")
    return Connectivity(bucketed(rows, "neighbours", n, *BLOCK), stencil, size, depth, n)


def spread(conn: Connectivity, field: DataFrame, column: str) -> str:
    """A column of field, dealt to the blocks that read it, as a bucketed table: bx, by, bz, x, y, z, v. The one exchange that a field takes."""
    rows = dealt(field.select(*COORDS, F.col(column).alias("v")), conn.size, conn.stencil.radius() * conn.depth, conn.buckets)
    return bucketed(rows, "spread", conn.buckets, *BLOCK)


def chained(conn: Connectivity, table: str, field: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """x, y, z, v after the folds in a row, of a column that was spread; planned without an exchange while CO_PARTITION is false."""
    if len(folds) > conn.depth:
        raise ValueError(f"the neighbour table serves {conn.depth} stencils in a row")
    spark, radius = field.sparkSession, conn.stencil.radius()
    state = spark.table(table)
    for k, fold in enumerate(folds):
        reach = radius * (conn.depth - 1 - k) if k < len(folds) - 1 else 0
        pairs = spark.table(conn.table).filter(within(conn.size, reach))
        values = state.select(*BLOCK, *[F.col(c).alias(f"n{c}") for c in COORDS], "v")
        # Compressed, these tables look small enough to be sent to the driver, which they aren't; merged, they stay where they lie.
        sums = pairs.join(values.hint("merge"), [*BLOCK, "nx", "ny", "nz"]).groupBy(*BLOCK, *COORDS).agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))
        joined = state.filter(within(conn.size, reach)).join(sums.hint("merge"), [*BLOCK, *COORDS], "left")
        state = joined.select(*BLOCK, *COORDS, fold(F.col("v"), F.coalesce("total", F.lit(0)), F.coalesce("n", F.lit(0))).alias("v"))
    return state.select(*BLOCK, *COORDS, "v")


def run(conn: Connectivity, field: DataFrame, column: str, folds: Sequence[Fold]) -> DataFrame:
    """x, y, z, v: a column of a field on the table's cells after some stencils in a row. The field is spread once; the result is written before it is given back."""
    spark = field.sparkSession
    table = spread(conn, field, column)
    with setting(spark, CO_PARTITION, "false"):
        done = bucketed(chained(conn, table, field, folds), "gathered", conn.buckets, *BLOCK)
    discard(spark, table)
    return spark.table(done).select(*COORDS, "v")
