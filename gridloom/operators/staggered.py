"""Staggered grids: voxels, and nodes at their corners. Node (x, y, z) is the lowest corner of voxel (x, y, z)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.spec import COORDS

CORNERS = tuple((i, j, k) for k in (0, 1) for j in (0, 1) for i in (0, 1))


def _explode(rows: DataFrame, sign: int, columns: list[str]) -> DataFrame:
    corners = F.array(*[F.struct(*[F.lit(v * sign).alias(f"d{c}") for v, c in zip(o, COORDS, strict=True)]) for o in CORNERS])
    out = rows.select(*COORDS, *columns, F.explode(corners).alias("o"))
    return out.select(*[(F.col(c) + F.col(f"o.d{c}")).cast("int").alias(c) for c in COORDS], *columns)


def nodes_of(voxels: DataFrame) -> DataFrame:
    """All corners of some voxels."""
    return _explode(voxels.select(*COORDS), 1, []).distinct()


def voxel_sums(nodes: DataFrame, voxels: DataFrame, column: str) -> DataFrame:
    """The sum of a voxel's eight nodes."""
    sums = _explode(nodes.select(*COORDS, column), -1, [column]).groupBy(*COORDS).agg(F.sum(column).alias("value"))
    return voxels.select(*COORDS).join(sums, list(COORDS))


def node_means(voxels: DataFrame, column: str) -> DataFrame:
    """The sum over a node's voxels, divided by eight even where some are missing."""
    sums = _explode(voxels.select(*COORDS, column), 1, [column]).groupBy(*COORDS).agg(F.sum(column).alias("s"))
    return sums.select(*COORDS, (F.col("s") / F.lit(8.0)).alias("value"))


def node_of_voxel(voxels: DataFrame, nodes: DataFrame, corner: tuple[int, int, int], column: str) -> DataFrame:
    """A voxel's node in a corner of signs -1 and +1."""
    shift = [F.col(c) - (1 if s > 0 else 0) for c, s in zip(COORDS, corner, strict=True)]
    moved = nodes.select(*[a.cast("int").alias(c) for a, c in zip(shift, COORDS, strict=True)], F.col(column).alias("value"))
    return voxels.select(*COORDS).join(moved, list(COORDS), "left")


def voxel_of_node(nodes: DataFrame, voxels: DataFrame, corner: tuple[int, int, int], column: str, alternative: float = 0.0) -> DataFrame:
    """A node's voxel on the side of signs -1 and +1; an inactive one reads the alternative, with valid false."""
    shift = [F.col(c) + (1 if s < 0 else 0) for c, s in zip(COORDS, corner, strict=True)]
    moved = voxels.select(*[a.cast("int").alias(c) for a, c in zip(shift, COORDS, strict=True)], F.col(column).alias("_v"), F.lit(True).alias("_ok"))
    joined = nodes.select(*COORDS).join(moved, list(COORDS), "left")
    return joined.select(*COORDS, F.when(F.col("_ok"), F.col("_v")).otherwise(F.lit(alternative)).alias("value"), F.coalesce("_ok", F.lit(False)).alias("valid"))


def add_constant(rows: DataFrame, columns: list[str], value: float) -> DataFrame:
    """Nodes or voxels with a constant added to each column."""
    return rows.withColumns({c: F.col(c) + F.lit(value) for c in columns})


def id_check(nodes: DataFrame, voxels: DataFrame, ids: tuple[str, str, str]) -> DataFrame:
    """Per voxel the nodes at its corners whose ids are their own coordinates (matches) and those whose aren't (mismatches)."""
    right = F.lit(True)
    for c, i in zip(COORDS, ids, strict=True):
        right = right & F.col(i).eqNullSafe(F.col(c))
    sent = _explode(nodes.select(*COORDS, right.cast("int").alias("_right")), -1, ["_right"])
    seen = sent.groupBy(*COORDS).agg(F.sum("_right").alias("matches"), F.sum(1 - F.col("_right")).alias("mismatches"))
    none = F.lit(0).cast("long")
    return voxels.select(*COORDS).join(seen, list(COORDS), "left").select(*COORDS, F.coalesce("matches", none).alias("matches"), F.coalesce("mismatches", none).alias("mismatches"))
