"""Triangle meshes as grid geometry: read, centre, scale, rotate, and tell which cells lie inside."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.spec import COORDS


def read_obj(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and triangles of a Wavefront OBJ file; larger faces are cut into fans."""
    points, faces = [], []
    for line in Path(path).read_text().splitlines():
        kind, *rest = line.split() or [""]
        if kind == "v":
            points.append([float(v) for v in rest[:3]])
        elif kind == "f":
            at = [int(v.split("/")[0]) for v in rest]
            at = [i - 1 if i > 0 else len(points) + i for i in at]
            faces += [(at[0], at[k], at[k + 1]) for k in range(1, len(at) - 1)]
    return np.array(points, float).reshape(-1, 3), np.array(faces, int).reshape(-1, 3)


def fit(points: np.ndarray, center: tuple[float, float, float], size: float, degrees: tuple[float, float, float] = (0, 0, 0)) -> np.ndarray:
    """Centres the bounding box, scales its longest side to size, rotates about x, y and z, and moves it to center."""
    low, high = points.min(0), points.max(0)
    out = (points - (low + high) / 2) * (size / (high - low).max())
    turn = np.eye(3)
    for axis, angle in enumerate(np.deg2rad(degrees)):
        i, j = [(1, 2), (2, 0), (0, 1)][axis]
        r = np.eye(3)
        r[i, i] = r[j, j] = np.cos(angle)
        r[i, j], r[j, i] = -np.sin(angle), np.sin(angle)
        turn = turn @ r
    return out @ turn + np.asarray(center)


def net(n: int) -> tuple[np.ndarray, np.ndarray]:
    """A closed cube of side 1, outward oriented, each face n x n squares of two triangles."""
    points, faces = [], []
    for axis in range(3):
        for end in (0, 1):
            base = len(points)
            for i in range(n + 1):
                for j in range(n + 1):
                    p = [0.0, 0.0, 0.0]
                    p[axis], p[(axis + 1) % 3], p[(axis + 2) % 3] = end, i / n, j / n
                    points.append(p)
            for i in range(n):
                for j in range(n):
                    a, b, c, d = (base + (i + u) * (n + 1) + j + v for u, v in ((0, 0), (1, 0), (1, 1), (0, 1)))
                    faces += [(a, b, c), (a, c, d)] if end else [(a, c, b), (a, d, c)]
    return np.array(points), np.array(faces)


def winding(cells: np.ndarray, triangles: np.ndarray) -> np.ndarray:
    """The winding number of a closed surface about each cell: 1 inside, 0 outside."""
    total = np.zeros(len(cells))
    for t in triangles:
        a, b, c = (v - cells for v in t)
        la, lb, lc = (np.linalg.norm(v, axis=1) for v in (a, b, c))
        over = np.einsum("ij,ij->i", a, np.cross(b, c))
        under = la * lb * lc + np.einsum("ij,ij->i", a, b) * lc + np.einsum("ij,ij->i", b, c) * la + np.einsum("ij,ij->i", c, a) * lb
        total += 2 * np.arctan2(over, under)
    return total / (4 * np.pi)


def distance(cells: np.ndarray, triangles: np.ndarray) -> np.ndarray:
    """Distance to the nearest point of any triangle."""
    best = np.full(len(cells), np.inf)
    for a, b, c in triangles:
        ab, ac = b - a, c - a
        n = np.cross(ab, ac)
        nn = n @ n
        if nn > 0:
            p = cells - a
            v, w = np.cross(p, ac) @ n / nn, np.cross(ab, p) @ n / nn
            inside = (v >= 0) & (w >= 0) & (v + w <= 1)
            best = np.where(inside, np.minimum(best, np.abs(p @ n) / np.sqrt(nn)), best)
        for s, e in ((a, b), (b, c), (c, a)):
            d = e - s
            t = np.clip((cells - s) @ d / max(d @ d, 1e-300), 0, 1)
            best = np.minimum(best, np.linalg.norm(cells - (s + t[:, None] * d), axis=1))
    return best


POINTS = tuple(f"{v}{c}" for v in "abc" for c in COORDS)
#: Cells along the side of a block, groups of triangles at most, triangles that travel together, and triangles at most (of 72 bytes) that go to all tasks.
SIDE, CLUSTERS, PACK, EVERYWHERE = 8, 4096, 512, 100_000


def triangles_of(spark: SparkSession, points: np.ndarray, faces: np.ndarray) -> DataFrame:
    """A row per triangle: ax, ay, az, bx, ..., cz."""
    flat = np.asarray(points, float)[np.asarray(faces, int)].reshape(-1, 9)
    return spark.createDataFrame(pa.table([pa.array(flat[:, k]) for k in range(9)], names=list(POINTS)))


def crossings(triangles: DataFrame) -> DataFrame:
    """y, z, x, turn: where lines along x through whole y and z cross each triangle, and whether they come in (-1) or out (1).

    A triangle gives its own lines only, by its extent. A line through an edge or a corner counts as if it ran a little above it in z and y, so that it meets one of the
    triangles that share it; triangles that lie along x give none.
    """
    schema = pa.schema([("y", pa.int32()), ("z", pa.int32()), ("x", pa.float64()), ("turn", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            t = np.stack([part.column(c).to_numpy() for c in POINTS], axis=1).reshape(-1, 3, 3)
            low, high = np.floor(t[:, :, 1:].min(1)).astype(np.int64), np.ceil(t[:, :, 1:].max(1)).astype(np.int64)
            wide = high - low + 1
            for y0, z0, ny, nz, tri in zip(low[:, 0].tolist(), low[:, 1].tolist(), wide[:, 0].tolist(), wide[:, 1].tolist(), t, strict=True):
                area = (tri[1, 1] - tri[0, 1]) * (tri[2, 2] - tri[0, 2]) - (tri[1, 2] - tri[0, 2]) * (tri[2, 1] - tri[0, 1])
                if not area:
                    continue
                # Some rows of lines at a time, so that a large triangle needs no more memory than a small one.
                for s in range(0, ny, max(1, 65536 // nz)):
                    y, z = (v.ravel() for v in np.meshgrid(np.arange(y0 + s, min(y0 + ny, y0 + s + max(1, 65536 // nz))), np.arange(z0, z0 + nz), indexing="ij"))
                    within, weight = np.ones(len(y), bool), []
                    for k in range(3):
                        # An edge is judged in one direction, whichever triangle it belongs to.
                        p, q = tri[(k + 1) % 3], tri[(k + 2) % 3]
                        flip = (p[1], p[2]) > (q[1], q[2])
                        p, q = (q, p) if flip else (p, q)
                        side = (q[1] - p[1]) * (z - p[2]) - (q[2] - p[2]) * (y - p[1])
                        left = (side > 0) | ((side == 0) & ((q[1] > p[1]) | ((q[1] == p[1]) & (q[2] < p[2]))))
                        within &= left == ((area > 0) != flip)
                        weight.append(-side if flip else side)
                    if within.any():
                        x = sum(w[within] * tri[k, 0] for k, w in enumerate(weight)) / area
                        yield pa.RecordBatch.from_arrays([pa.array(y[within], pa.int32()), pa.array(z[within], pa.int32()), pa.array(x), pa.array(np.full(len(x), 1 if area > 0 else -1, np.int32))], schema=schema)

    return triangles.select(*POINTS).mapInArrow(run, "y int, z int, x double, turn int")


def inside_of(cells: DataFrame, triangles: DataFrame) -> DataFrame:
    """x, y, z, inside: whether a closed, outward oriented surface winds about a cell: the turns of what its line crosses beyond it add up to 1 or more.

    Cells and crossings of a line are dealt together and summed up in the order of x.
    """
    events = cells.select("y", "z", F.col("x").cast("double").alias("at"), F.lit(0).alias("turn"), F.col("x").alias("cell"))
    events = events.unionByName(crossings(triangles).select("y", "z", F.col("x").alias("at"), "turn", F.lit(None).cast("int").alias("cell")))
    beyond = W.partitionBy("y", "z").orderBy(F.col("at").desc(), F.col("cell").isNull().cast("int")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return events.withColumn("n", F.sum("turn").over(beyond)).filter("cell IS NOT NULL").select(F.col("cell").alias("x"), "y", "z", (F.col("n") > 0).alias("inside"))


def apart(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Distances between one box and several."""
    return np.linalg.norm(np.maximum(0, np.maximum(lows - high, low - highs)), axis=1)


def spots(low: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Cells of a block by their places in it."""
    p = places.astype(np.int64)
    return low + np.stack([p % SIDE, p // SIDE % SIDE, p // SIDE**2], axis=1).astype(float)


def pairwise(cells: np.ndarray, triangles: np.ndarray) -> np.ndarray:
    """Distance from each cell to the triangle in the same row."""
    dot = lambda u, v: np.einsum("ij,ij->i", u, v)
    a, b, c = (triangles[:, k] for k in range(3))
    p, ab, ac = cells - a, b - a, c - a
    n = np.cross(ab, ac)
    nn = dot(n, n)
    flat = np.maximum(nn, 1e-300)
    v, w = dot(np.cross(p, ac), n) / flat, dot(np.cross(ab, p), n) / flat
    best = np.where((nn > 0) & (v >= 0) & (w >= 0) & (v + w <= 1), np.abs(dot(p, n)) / np.sqrt(flat), np.inf)
    for s, e in ((a, b), (b, c), (c, a)):
        d = e - s
        t = np.clip(dot(cells - s, d) / np.maximum(dot(d, d), 1e-300), 0, 1)
        best = np.minimum(best, np.linalg.norm(cells - (s + t[:, None] * d), axis=1))
    return best


def nearest(cells: np.ndarray, triangles: np.ndarray) -> np.ndarray:
    """distance(), but a cell is held only against triangles whose box is no further from it than the nearest corner known."""
    best = np.full(len(cells), np.inf)
    for s in range(0, len(triangles), 64):
        some = triangles[s : s + 64]
        at = cells[:, None]
        least = np.linalg.norm(np.maximum(0, np.maximum(some.min(1) - at, at - some.max(1))), axis=2)
        most = reduce(np.minimum, [np.linalg.norm(at - some[:, k], axis=2).min(1) for k in range(3)], best)
        cell, triangle = np.nonzero(least <= most[:, None] * (1 + 1e-9))
        if len(cell):
            starts = np.flatnonzero(np.diff(cell, prepend=-1))
            found = np.minimum.reduceat(pairwise(cells[cell], some[triangle]), starts)
            best[cell[starts]] = np.minimum(best[cell[starts]], found)
    return best


def distances(cells: DataFrame, triangles: DataFrame) -> DataFrame:
    """x, y, z, distance to the nearest triangle, for cells, if there are any triangles.

    Triangles are grouped by place; the groups' side is doubled until there are at most CLUSTERS of them, so their boxes are a table of bounded size. A block of
    cells is held against these: groups whose box lies further than the surest other one can't hold a nearest triangle. Blocks are joined with
    the triangles of the groups that are left, PACK at a time.
    """
    side = float(SIDE)
    middle = [((F.col(f"a{c}") + F.col(f"b{c}") + F.col(f"c{c}")) / 3.0) for c in COORDS]
    while True:
        keyed = triangles.select(*POINTS, *[F.floor(m / side).alias(f"g{c}") for m, c in zip(middle, COORDS, strict=True)])
        if keyed.select("gx", "gy", "gz").distinct().limit(CLUSTERS + 1).count() <= CLUSTERS:
            break
        side *= 2
    keyed = keyed.withColumn("cluster", F.concat_ws(" ", "gx", "gy", "gz"))
    extent = [f(*[F.col(f"{v}{c}") for v in "abc"]) for f in (F.least, F.greatest) for c in COORDS]
    boxes = keyed.groupBy("cluster").agg(*[F.min(e) for e in extent[:3]], *[F.max(e) for e in extent[3:]], *[F.first(f"a{c}") for c in COORDS], F.count(F.lit(1))).collect()
    names = [r[0] for r in boxes]
    data = np.array([r[1:10] for r in boxes], float).reshape(-1, 9)
    lows, highs, sure = data[:, :3], data[:, 3:6], data[:, 6:]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block once for every group of triangles that can be nearest to one of its cells: of the groups that can for some place in it, those that no cell rules out."""
        for part in batches:
            lists, origin = part.column("cells"), np.stack([part.column(f"b{c}").to_numpy() for c in COORDS], axis=1) * SIDE
            places, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            for k, low in enumerate(origin):
                own = places[ends[k] : ends[k + 1]]
                at = spots(low, own)
                near, far = at.min(0), at.max(0)
                corners = np.stack(np.meshgrid(*zip(near, far, strict=True), indexing="ij"), -1).reshape(-1, 3)
                most = np.linalg.norm(corners[:, None] - sure, axis=2).max(0).min() if len(sure) else 0
                found = np.flatnonzero(apart(near, far, lows, highs) <= most * (1 + 1e-9))
                least, bound = np.empty((len(found), len(at))), np.full(len(at), np.inf)
                for i, g in enumerate(found):
                    least[i] = apart(at, at, lows[g], highs[g])
                    bound = np.minimum(bound, np.linalg.norm(at - sure[g], axis=1))
                found = found[(least <= bound * (1 + 1e-9)).any(1)]
                block = np.asarray(low, "<i4").tobytes() + own.astype("<i2").tobytes()
                yield pa.RecordBatch.from_pydict({"cluster": [names[i] for i in found], "block": [block] * len(found)}, schema=pa.schema([("cluster", pa.string()), ("block", pa.binary())]))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted triangles, PACK of a group at most in a row."""
        for part in batches:
            flat = np.stack([part.column(c).to_numpy() for c in POINTS], axis=1)
            group = part.column("cluster").to_pylist()
            cuts = [0, *[k for k in range(1, len(group)) if group[k] != group[k - 1]], len(group)]
            spans = [(s, min(e, s + PACK)) for a, e in zip(cuts[:-1], cuts[1:], strict=True) for s in range(a, e, PACK)]
            yield pa.RecordBatch.from_pydict({"cluster": [group[s] for s, _ in spans], "pack": [flat[s:e].tobytes() for s, e in spans]}, schema=pa.schema([("cluster", pa.string()), ("pack", pa.binary())]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for block, pack in zip(part.column("block").to_pylist(), part.column("pack").to_pylist(), strict=True):
                at = spots(np.frombuffer(block, "<i4", 3), np.frombuffer(block, "<i2", offset=12))
                best = nearest(at, np.frombuffer(pack, "<f8").reshape(-1, 3, 3))
                yield pa.RecordBatch.from_arrays([*[pa.array(at[:, k].astype(np.int32)) for k in range(3)], pa.array(best)], names=[*COORDS, "distance"])

    n = int(triangles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = reduce(lambda a, b: a + b, [F.pmod(F.col(c), F.lit(SIDE)) * SIDE**k for k, c in enumerate(COORDS)]).cast("short")
    dealt = cells.select(*[F.floor(F.col(c) / SIDE).alias(f"b{c}") for c in COORDS], place.alias("at")).repartition(n, *[f"b{c}" for c in COORDS])
    blocks = dealt.groupBy(*[f"b{c}" for c in COORDS]).agg(F.collect_list("at").alias("cells"))
    pairs = blocks.mapInArrow(choose, "cluster string, block binary")
    packs = keyed.select("cluster", *POINTS).repartition("cluster").sortWithinPartitions("cluster").mapInArrow(fold, "cluster string, pack binary")
    # By group, blocks around a small mesh would meet in few tasks; its triangles go to the blocks instead.
    if sum(r[10] for r in boxes) <= EVERYWHERE:
        packs = F.broadcast(packs)
    else:
        pairs = pairs.repartition(n, "cluster")
    rows = pairs.join(packs, "cluster").select("block", "pack").mapInArrow(measure, "x int, y int, z int, distance double")
    return rows.groupBy(*COORDS).agg(F.min("distance").alias("distance"))


def with_triangles(cells: DataFrame, triangles: DataFrame) -> DataFrame:
    """x, y, z, inside and distance of cells, for a closed surface of triangles(ax, ..., cz), outward oriented, of any number.

    Without triangles nothing is inside and distances are infinite; a triangle without area is taken as a line or a point.
    """
    rows = inside_of(cells.select(*COORDS), triangles).join(distances(cells.select(*COORDS), triangles), list(COORDS), "left")
    return rows.select(*COORDS, "inside", F.coalesce("distance", F.lit(float("inf"))).alias("distance"))


def with_mesh(cells: DataFrame, points: np.ndarray, faces: np.ndarray) -> DataFrame:
    """Adds inside and distance to x, y, z, for a mesh that the driver has read."""
    return with_triangles(cells, triangles_of(cells.sparkSession, points, faces))
