"""How a grid is cut into slabs along z, and what each cell is to its slab. Results never depend on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.plans.checkpoint import cut
from gridloom.spec import COORDS


def dense_slab(nz: int, slabs: int, z: Column | str = "z") -> Column:
    """Slab numbers of a dense cut; the first nz % slabs slabs are one plane higher."""
    if nz < slabs:
        raise ValueError("fewer planes than slabs")
    z = F.col(z) if isinstance(z, str) else z
    high, extra = nz // slabs + 1, nz % slabs
    return F.when(z < high * extra, F.floor(z / high)).otherwise(F.floor((z - high * extra) / (nz // slabs)) + extra).cast("int")


def slab_bounds(nz: int, slabs: int) -> list[tuple[int, int]]:
    out, at = [], 0
    for k in range(slabs):
        n = nz // slabs + (k < nz % slabs)
        out.append((at, at + n))
        at += n
    return out


def running_counts(cells: DataFrame) -> DataFrame:
    """z, upto: how many cells lie in each plane that has some, and below it.

    Planes are dealt by ranges of z and summed up there; a range starts with what the ranges before it have, one row per range.
    """
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    planes = cut(cells.groupBy("z").agg(F.count(F.lit(1)).alias("n")), "planes")
    dealt = cut(planes.repartitionByRange(n, "z").select("z", "n", F.spark_partition_id().alias("part")), "planes", planes)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ranges = dealt.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.sum("n").over(W.partitionBy("part").orderBy("z"))
    return dealt.join(ranges, "part").select("z", (within + F.col("start")).alias("upto"))


def sparse_bounds(cells: DataFrame, slabs: int, least: int = 3) -> list[tuple[int, int]]:
    """Slabs of about equal numbers of active cells, at least `least` planes each.

    A slab ends with the first plane by which it holds its share, found in the running counts of planes. The driver sees one row per slab, however many planes there are.
    """
    counts = cut(running_counts(cells), "planes")
    first, last, total = counts.agg(F.min("z"), F.max("z") + 1, F.max("upto")).first()
    if first is None or last - first < least * slabs:
        raise ValueError("too few planes for the slabs")
    share, cuts, held = -(-total // slabs), [first], 0
    while len(cuts) < slabs:
        found = counts.filter(F.col("upto") >= held + share).agg(F.min(F.struct("z", "upto")).alias("p")).first()["p"]
        cuts.append(last if found is None else found["z"] + 1)
        held = total if found is None else found["upto"]
    cuts.append(last)
    # From the end, then from the start: no slab is thinner than allowed.
    for k in range(slabs - 1, 0, -1):
        cuts[k] = min(cuts[k], cuts[k + 1] - least)
    for k in range(1, slabs):
        cuts[k] = max(cuts[k], cuts[k - 1] + least)
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def slab_of(bounds: list[tuple[int, int]], z: str = "z") -> Column:
    out = F.lit(None).cast("int")
    for k, (low, high) in enumerate(bounds):
        out = F.when((F.col(z) >= low) & (F.col(z) < high), k).otherwise(out)
    return out


def data_view(bounds: list[tuple[int, int]], radius: int = 1, z: str = "z") -> Column:
    """BOUNDARY: within radius of another slab's planes; INTERNAL: the rest. One slab is all INTERNAL."""
    if len(bounds) > 1 and any(high - low < 2 * radius + 1 for low, high in bounds):
        raise ValueError("a slab is thinner than its boundaries")
    out = F.lit("INTERNAL")
    for k, (low, high) in enumerate(bounds):
        inside = (F.col(z) >= low) & (F.col(z) < high)
        near = F.lit(False)
        if k:
            near = near | (F.col(z) < low + radius)
        if k < len(bounds) - 1:
            near = near | (F.col(z) >= high - radius)
        out = F.when(inside & near, F.lit("BOUNDARY")).otherwise(out)
    return out


def direction(bounds: list[tuple[int, int]], radius: int = 1, z: str = "z") -> Column:
    """UP or DOWN for boundary cells, by the side that they lie on; null for others."""
    out = F.lit(None).cast("string")
    for k, (low, high) in enumerate(bounds):
        inside = (F.col(z) >= low) & (F.col(z) < high)
        if k:
            out = F.when(inside & (F.col(z) < low + radius), F.lit("DOWN")).otherwise(out)
        if k < len(bounds) - 1:
            out = F.when(inside & (F.col(z) >= high - radius), F.lit("UP")).otherwise(out)
    return out


def properties(cells: DataFrame, bounds: list[tuple[int, int]], radius: int = 1) -> DataFrame:
    """x, y, z, slab, data_view and side of every cell."""
    return cells.select(*COORDS, slab_of(bounds).alias("slab"), data_view(bounds, radius).alias("data_view"), direction(bounds, radius).alias("side"))


def halo_update(field: DataFrame, bounds: list[tuple[int, int]], radius: int = 1, semantic: str = "standard") -> DataFrame:
    """slab, ghost and the field's columns: every slab's own cells, and copies of its neighbours' planes within the radius.

    Each boundary cell is sent to the slab beyond its face, so no shuffle is needed. Stencils don't need ghosts, since they
    exchange by themselves; this is for engines that take a slab with its halo. Only the standard semantic exists.
    """
    if semantic != "standard":
        raise ValueError(f"unknown semantic: {semantic}")
    side, own = direction(bounds, radius), slab_of(bounds)
    beyond = F.when(side == "DOWN", F.array(own, own - 1)).when(side == "UP", F.array(own, own + 1)).otherwise(F.array(own))
    if len(bounds) > 1 and any(high - low < 2 * radius for low, high in bounds):
        raise ValueError("a slab is thinner than its boundaries")
    return field.filter(own.isNotNull()).select(F.posexplode(beyond).alias("_copy", "slab"), "*").withColumn("ghost", F.col("_copy") > 0).drop("_copy")


def place(cells: DataFrame, parts: int) -> DataFrame:
    """Rows in ranges of z, as the slabs are."""
    return cells.repartitionByRange(parts, "z")


def lookup(points: DataFrame, table: DataFrame) -> DataFrame:
    """What a table of points knows about some points; unknown ones get nulls."""
    return points.join(table, list(COORDS), "left")
