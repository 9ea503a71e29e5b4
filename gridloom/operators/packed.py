"""Packed block tables: a stored grid with one row per block, and stencils on it that move nothing but faces.

A row has the block's coordinates bx, by, bz, a bit per cell (`active`) and for each column one array of its values, cell by
cell with x fastest; a column may have several components per cell, which then lie together. The table is bucketed by block. A step reads it, sends
each block's outermost cells to the blocks beyond that read them, joins these to their block where it lies, and writes the next
table in the same buckets. So the exchange holds faces (edges and corners where a stencil needs them), and the blocks themselves never move.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.plans.checkpoint import bucketed, discard, setting
from gridloom.spec import COORDS, S6, Offset, Stencil

SIZE = 8
BLOCK = ("bx", "by", "bz")
#: Bytes of block values that a task takes in at a time.
BYTES = 1 << 25
#: Cells of a bucket, where their number says how many buckets a table has.
CELLS = 1 << 17
NUMPY = {"int": "<i4", "bigint": "<i8", "double": "<f8", "float": "<f4"}


@dataclass(frozen=True)
class Field:
    """A column of a packed table: its type per component, and components per cell (0: a plain number)."""

    name: str
    kind: str
    card: int = 0

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(NUMPY[self.kind])

    @property
    def width(self) -> int:
        return max(1, self.card)


@dataclass(frozen=True)
class Packed:
    """A packed table under a name of the session's catalog."""

    spark: SparkSession
    table: str
    fields: tuple[Field, ...]
    size: int
    buckets: int

    def frame(self) -> DataFrame:
        return self.spark.table(self.table)

    def field(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)

    def drop(self) -> None:
        discard(self.spark, self.table)


@dataclass(frozen=True)
class Halo:
    """What a kernel sees: boxes [block, z, y, x] (and component) of some blocks, `radius` cells wider on each side than a block."""

    values: dict[str, np.ndarray]
    valid: np.ndarray
    size: int
    radius: int

    def at(self, name: str | None = None, offset: Offset = (0, 0, 0), component: int | None = None) -> np.ndarray:
        """The column (or with None: which cells exist) at an offset (x, y, z) from each cell of the blocks."""
        a = self.valid if name is None else self.values[name]
        r = self.radius
        view = a[(slice(None), *(slice(r + o, r + o + self.size) for o in reversed(offset)))]
        return view if component is None else view[..., component]


#: Neighbours along each axis, up before down.
AXES = Stencil(((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)))
Kernel = Callable[[Halo], dict[str, np.ndarray]]


def schema_of(fields: Sequence[Field]) -> T.StructType:
    kinds = {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "float": T.FloatType()}
    return T.StructType([*[T.StructField(c, T.IntegerType()) for c in BLOCK], T.StructField("active", T.BinaryType()), *[T.StructField(f.name, T.ArrayType(kinds[f.kind])) for f in fields]])


def arrow_of(fields: Sequence[Field]) -> pa.Schema:
    return pa.schema([*[(c, pa.int32()) for c in BLOCK], ("active", pa.binary()), *[(f.name, pa.list_(pa.from_numpy_dtype(f.dtype))) for f in fields]])


def fields_of(frame: DataFrame, columns: Sequence[str], components: dict[str, int]) -> tuple[Field, ...]:
    out = []
    for c in columns:
        kind = frame.schema[c].dataType
        array = isinstance(kind, T.ArrayType)
        name = (kind.elementType if array else kind).simpleString()
        if name not in NUMPY:
            raise ValueError(f"no packed form of {c}: {kind.simpleString()}")
        if array and not components.get(c):
            raise ValueError(f"say how many components {c} has")
        out.append(Field(c, name, components[c] if array else 0))
    return tuple(out)


def bits(active: np.ndarray) -> list[bytes]:
    """[block, cell] as one bit string per block."""
    packed = np.packbits(active, axis=1)
    return [row.tobytes() for row in packed]


def flags(column: pa.Array, cells: int) -> np.ndarray:
    """[block, cell] of bit strings."""
    n = len(column)
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, -1)
    return np.unpackbits(data, axis=1, count=cells).astype(bool)


def count_bits(active: str) -> Column:
    """How many bits a binary column has set, from its hexadecimal digits."""
    digits = F.split(F.hex(active), "(?!$)")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: a + F.bit_count(F.conv(d, 16, 10).cast("int")))


def lists(values: np.ndarray) -> pa.Array:
    """[block, ...] as one list per block."""
    flat = values.reshape(len(values), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int64) * flat.shape[1], pa.int32()), pa.array(np.ascontiguousarray(flat).ravel()))


def boxes(column: pa.Array, field: Field, size: int) -> np.ndarray:
    """[block, z, y, x] (and component) of one list per block."""
    data = column.flatten().to_numpy(zero_copy_only=False)
    return data.reshape(len(column), size, size, size, *([field.card] if field.card else []))


def buckets_for(spark: SparkSession, cells: int, least: int = 12) -> int:
    """Buckets of about CELLS cells each, so that short iterations aren't mostly tasks without rows; the session's partitions at most."""
    return min(max(least, -(-cells // CELLS)), int(spark.conf.get("spark.sql.shuffle.partitions")))


def pack(cells: DataFrame, columns: Sequence[str], size: int = SIZE, components: dict[str, int] | None = None, buckets: int | None = None) -> Packed:
    """A packed table of cells(x, y, z, columns): the one time that cells are shuffled.

    Columns are whole or floating numbers, or arrays of them; components: how many an array column has. A null value is kept as 0.
    Cells with one place twice are an error. An empty grid makes a table without rows.
    """
    spark = cells.sparkSession
    fields = fields_of(cells, columns, components or {})
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    volume = size**3
    place = [F.floor(F.col(c) / size).cast("int").alias(b) for c, b in zip(COORDS, BLOCK, strict=True)]
    x, y, z = (F.pmod(F.col(c), F.lit(size)) for c in COORDS)
    rows = cells.select(*place, (x + y * size + z * size * size).cast("int").alias("_at"), *columns)
    rows = rows.repartition(n, *BLOCK).sortWithinPartitions(*BLOCK, "_at")
    out = arrow_of(fields)

    def fill(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        """Whole blocks of sorted cells, and the cells of the block that may go on."""
        at = np.stack([rows.column(c).to_numpy() for c in BLOCK], axis=1)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]).any(1)
        starts = np.flatnonzero(new)
        if not last:
            end, starts = (int(starts[-1]), starts[:-1]) if len(starts) else (0, starts)
        else:
            end = len(at)
        if not len(starts):
            return None, rows.slice(end)
        block = np.cumsum(new[:end]) - 1
        inside = rows.column("_at").to_numpy()[:end]
        if ((inside[1:] == inside[:-1]) & (block[1:] == block[:-1])).any():
            raise ValueError("two cells have one place")
        active = np.zeros((len(starts), volume), bool)
        active[block, inside] = True
        arrays = []
        for f in fields:
            column = rows.column(f.name).slice(0, end).combine_chunks()
            if f.card:
                sizes = np.asarray(column.value_lengths().fill_null(f.card))
                if (sizes != f.card).any():
                    raise ValueError(f"{f.name} must have {f.card} components in every cell")
                data = np.zeros((end, f.card), f.dtype)
                data[np.asarray(column.is_valid())] = column.flatten().fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, f.card)
            else:
                data = column.fill_null(0).to_numpy(zero_copy_only=False)
            box = np.zeros((len(starts), volume, *data.shape[1:]), f.dtype)
            box[block, inside] = data
            arrays.append(lists(box))
        places = [pa.array(at[starts, k], pa.int32()) for k in range(3)]
        return pa.RecordBatch.from_arrays([*places, pa.array(bits(active), pa.binary()), *arrays], schema=out), rows.slice(end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in batches:
            part = pa.Table.from_batches([part])
            made, held = fill(part if held is None else pa.concat_tables([held, part]), False)
            if made is not None:
                yield made
        if held is not None and held.num_rows:
            yield fill(held, True)[0]

    return Packed(spark, bucketed(rows.mapInArrow(run, schema_of(fields)), "packed", n, *BLOCK), fields, size, n)


def chunks(batches: Iterator[pa.RecordBatch], fields: Sequence[Field], size: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a piece has about BYTES of values at most, or one block."""
    each = size**3 * (1 + sum(f.dtype.itemsize * f.width for f in fields))
    step = max(1, BYTES // each)
    for part in batches:
        for s in range(0, part.num_rows, step):
            yield part.slice(s, step)


def unpack(table: Packed, columns: Sequence[str] | None = None) -> DataFrame:
    """x, y, z and columns of every cell; nothing is shuffled.

    Blocks go to Python by planes: how many rows it takes in at a time is the session's choice, which a block of many components is too large for.
    """
    fields = [table.field(c) for c in columns] if columns is not None else list(table.fields)
    size = table.size
    kinds = schema_of(fields)
    out = T.StructType([*[T.StructField(c, T.IntegerType()) for c in COORDS], *[T.StructField(f.name, kinds[f.name].dataType if f.card else kinds[f.name].dataType.elementType) for f in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, fields, size):
            n, plane = part.num_rows, part.column("_z").to_numpy()
            active = flags(part.column("active"), size**3).reshape(n, size, size**2)[np.arange(n), plane]
            row, at = np.nonzero(active)
            local = (at % size, at // size, plane[row])
            arrays = [pa.array(part.column(b).to_numpy()[row] * size + v, pa.int32()) for b, v in zip(BLOCK, local, strict=True)]
            for f in fields:
                data = part.column(f.name).flatten().to_numpy(zero_copy_only=False).reshape(n, size**2, *([f.card] if f.card else []))[row, at]
                arrays.append(lists(data) if f.card else pa.array(data))
            yield pa.RecordBatch.from_arrays(arrays, names=[*COORDS, *[f.name for f in fields]])

    planes = table.frame().select(*BLOCK, "active", *[f.name for f in fields], F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("_z"))
    own = [F.slice(f.name, F.col("_z") * (size**2 * f.width) + 1, F.lit(size**2 * f.width)).alias(f.name) for f in fields]
    return planes.select(*BLOCK, "active", "_z", *own).mapInArrow(run, out)


def directions(stencil: Stencil) -> list[Offset]:
    """The blocks beyond a block that its cells can read, as steps of one block."""
    found = {(0, 0, 0)}
    for o in stencil:
        reach = [(0,) if not a else (0, int(math.copysign(1, a))) for a in o]
        found |= {(i, j, k) for i in reach[0] for j in reach[1] for k in reach[2]}
    return sorted(found - {(0, 0, 0)})


def rim(step: Offset, size: int, radius: int) -> tuple[slice, ...]:
    """Of a block's own box [z, y, x]: the cells that the block at a step reads."""
    side = {0: slice(0, size), 1: slice(size - radius, size), -1: slice(0, radius)}
    return tuple(side[s] for s in reversed(step))


def hem(step: Offset, size: int, radius: int) -> tuple[slice, ...]:
    """Of a wide box: where the cells of the block at a step lie."""
    side = {0: slice(radius, radius + size), 1: slice(radius + size, 2 * radius + size), -1: slice(0, radius)}
    return tuple(side[s] for s in reversed(step))


def faces(table: Packed, reads: Sequence[str], stencil: Stencil, only: Callable[[str, Offset], Sequence[int] | None] | None = None) -> DataFrame:
    """bx, by, bz, side, active, data: for each block, what the block at each side of it sends to it.

    only: the components of a column that a block at a step needs (None: all). What has no active cell isn't sent.
    """
    fields, size, radius = [table.field(c) for c in reads], table.size, stencil.radius()
    if radius > size:
        raise ValueError("a stencil may not reach beyond the next block")
    steps = directions(stencil)
    out = pa.schema([*[(c, pa.int32()) for c in BLOCK], ("side", pa.int32()), ("rim", pa.binary()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, fields, size):
            n = part.num_rows
            active = flags(part.column("active"), size**3).reshape(n, size, size, size)
            wide = {f.name: boxes(part.column(f.name), f, size) for f in fields}
            for step in steps:
                cut = rim(step, size, radius)
                there = active[(slice(None), *cut)].reshape(n, -1)
                sent = np.flatnonzero(there.any(1))
                if not len(sent):
                    continue
                payload = [np.ascontiguousarray(wide[f.name][(sent, *cut)] if not f.card else wide[f.name][(sent, *cut)][..., list(pick(f, step))]).reshape(len(sent), -1).view(np.uint8) for f in fields]
                data = np.concatenate(payload, axis=1)
                places = [pa.array(part.column(b).to_numpy()[sent] + s, pa.int32()) for b, s in zip(BLOCK, step, strict=True)]
                yield pa.RecordBatch.from_arrays([*places, pa.array(np.full(len(sent), steps.index(tuple(-s for s in step)), np.int32)), pa.array(bits(there[sent]), pa.binary()), pa.array([d.tobytes() for d in data], pa.binary())], schema=out)

    def pick(f: Field, step: Offset) -> Sequence[int]:
        chosen = only(f.name, step) if only else None
        return range(f.width) if chosen is None else chosen

    rows = table.frame().select(*BLOCK, "active", *reads).mapInArrow(run, "bx int, by int, bz int, side int, rim binary, data binary")
    return rows.groupBy(*BLOCK).agg(F.collect_list(F.struct("side", "rim", "data")).alias("_faces"))


def joined(table: Packed, reads: Sequence[str], stencil: Stencil, only=None) -> DataFrame:
    """The table with each block's faces: the blocks stay where they are, faces are dealt to them."""
    return table.frame().join(faces(table, reads, stencil, only).hint("merge"), list(BLOCK), "left")


def step(
    table: Packed,
    kernel: Kernel,
    writes: Sequence[Field],
    reads: Sequence[str],
    stencil: Stencil = S6,
    only: Callable[[str, Offset], Sequence[int] | None] | None = None,
    keep: Sequence[str] = (),
    own: Sequence[str] = (),
    totals: Sequence[str] = (),
) -> Packed:
    """step_with_totals without the totals."""
    return step_with_totals(table, kernel, writes, reads, stencil, only, keep, own, totals)[0]


def step_with_totals(
    table: Packed,
    kernel: Kernel,
    writes: Sequence[Field],
    reads: Sequence[str],
    stencil: Stencil = S6,
    only: Callable[[str, Offset], Sequence[int] | None] | None = None,
    keep: Sequence[str] = (),
    own: Sequence[str] = (),
    totals: Sequence[str] = (),
) -> tuple[Packed, dict[str, float]]:
    """The next table: what the kernel makes of the columns that it reads through the stencil, and the columns to keep as they are.

    The kernel gets boxes of several blocks with their halos, and returns boxes [block, z, y, x] for `writes`; cells that don't exist stay so.
    own: columns that it reads in the cell itself only; they are 0 in halos, and aren't sent. totals: names of numbers per block that the kernel
    returns beside its boxes; their sums over all blocks are gathered while the table is written, in the same job.
    """
    size, radius = table.size, stencil.radius()
    steps, kept = directions(stencil), [table.field(c) for c in keep]
    fields, inner = [table.field(c) for c in reads], [table.field(c) for c in own]
    made = tuple([*writes, *kept])
    out = pa.schema([*arrow_of(made), *[(c, pa.float64()) for c in totals]])
    kind = T.StructType([*schema_of(made), *[T.StructField(c, T.DoubleType()) for c in totals]])

    def pick(f: Field, step: Offset) -> list[int]:
        chosen = only(f.name, step) if only else None
        return list(range(f.width)) if chosen is None else list(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, [*fields, *inner, *made], size):
            n, side = part.num_rows, size + 2 * radius
            here = flags(part.column("active"), size**3).reshape(n, size, size, size)
            valid = np.zeros((n, side, side, side), bool)
            center = (slice(None), *hem((0, 0, 0), size, radius))
            valid[center] = here
            values = {}
            for f in [*fields, *inner]:
                values[f.name] = np.zeros((n, side, side, side, *([f.card] if f.card else [])), f.dtype)
                values[f.name][center] = boxes(part.column(f.name), f, size)
            near = part.column("_faces")
            block = np.repeat(np.arange(n), np.asarray(near.value_lengths().fill_null(0)))
            flat = near.flatten()
            sides = flat.field("side").to_numpy(zero_copy_only=False)
            for k, s in enumerate(steps):
                rows = np.flatnonzero(sides == k)
                if not len(rows):
                    continue
                at, to = block[rows], hem(s, size, radius)
                shape = valid[(slice(0, 1), *to)].shape[1:]
                valid[(at, *to)] = flags(flat.field("rim").take(pa.array(rows)), math.prod(shape)).reshape(-1, *shape)
                data, start = np.frombuffer(b"".join(flat.field("data").take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1), 0
                for f in fields:
                    # The block at this side sent what is needed on its way here, against the step.
                    chosen = pick(f, tuple(-a for a in s)) if f.card else [0]
                    width = math.prod(shape) * len(chosen) * f.dtype.itemsize
                    got = np.ascontiguousarray(data[:, start : start + width]).view(f.dtype)
                    start += width
                    if f.card:
                        box = np.zeros((len(rows), *shape, f.card), f.dtype)
                        box[..., chosen] = got.reshape(len(rows), *shape, len(chosen))
                        values[f.name][(at, *to)] = box
                    else:
                        values[f.name][(at, *to)] = got.reshape(len(rows), *shape)
            result = kernel(Halo(values, valid, size, radius))
            arrays = []
            for f in writes:
                box = np.where(here.reshape(*here.shape, *([1] if f.card else [])), result[f.name], 0).astype(f.dtype)
                arrays.append(lists(box))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in BLOCK], part.column("active"), *arrays, *[part.column(f.name) for f in kept], *[pa.array(result[c], pa.float64()) for c in totals]], schema=out)

    columns = list(dict.fromkeys([*reads, *own, *keep]))
    rows = joined(table, reads, stencil, only).select(*BLOCK, "active", *columns, "_faces")
    # A batch of rows is as large as what is taken in at a time, and faces are dealt into as many parts as the table has buckets.
    each = size**3 * (1 + sum(table.field(c).dtype.itemsize * table.field(c).width for c in columns))
    with setting(table.spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(max(1, BYTES // each))), setting(table.spark, "spark.sql.shuffle.partitions", str(table.buckets)):
        rows, seen = rows.mapInArrow(run, kind), Observation()
        if totals:
            rows = rows.observe(seen, *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in totals]).drop(*totals)
        after = replace(table, table=bucketed(rows, "packed", table.buckets, *BLOCK), fields=made)
    return after, dict(seen.get) if totals else {}


def iterate(table: Packed, steps: int, kernel: Kernel, writes: Sequence[Field], reads: Sequence[str], stencil: Stencil = S6, only=None, keep: Sequence[str] = (), own: Sequence[str] = ()) -> Packed:
    """So many steps in a row. Each table but the first is dropped once the next one is written."""
    first = table
    for _ in range(steps):
        after = step(table, kernel, writes, reads, stencil, only, keep, own)
        if table is not first:
            table.drop()
        table = after
    return table


def sums(h: Halo, name: str, stencil: Stencil = S6) -> tuple[np.ndarray, np.ndarray]:
    """The sum over valid neighbours, and their number."""
    total = np.zeros_like(h.at(name))
    count = np.zeros(total.shape, np.int64)
    for o in stencil:
        ok = h.at(None, o)
        total += np.where(ok, h.at(name, o), 0)
        count += ok
    return total, count


def laplace_count(name: str) -> Kernel:
    """value - count x sum over valid neighbours."""

    def kernel(h: Halo) -> dict[str, np.ndarray]:
        total, count = sums(h, name)
        return {name: h.at(name) - count * total}

    return kernel


def laplace_matvec(name: str, boundary: str, out: str, spacing: float = 1.0) -> Kernel:
    """(count x center - sum) / h^2 in free cells; fixed cells (boundary = 0) pass their value on."""

    def kernel(h: Halo) -> dict[str, np.ndarray]:
        total, count = sums(h, name)
        return {out: np.where(h.at(boundary) == 0, h.at(name), (count * h.at(name) - total) / (spacing * spacing))}

    return kernel


def gradient(name: str, out: str, spacing: float = 1.0) -> Kernel:
    """Central differences with three components; 0 where a neighbour is missing."""

    def kernel(h: Halo) -> dict[str, np.ndarray]:
        axes = ((1, 0, 0), (0, 1, 0), (0, 0, 1))
        every = np.logical_and.reduce([h.at(None, tuple(s * a for a in o)) for o in axes for s in (1, -1)])
        parts = [(h.at(name, o) - h.at(name, tuple(-a for a in o))) / (2.0 * spacing) for o in axes]
        return {out: np.where(every[..., None], np.stack(parts, -1), 0.0)}

    return kernel


def life(name: str) -> Kernel:
    """One generation in every z-plane."""
    ring = Stencil(tuple((a, b, 0) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b))

    def kernel(h: Halo) -> dict[str, np.ndarray]:
        total, _ = sums(h, name, ring)
        return {name: (total == 3) | ((total == 2) & (h.at(name) > 0))}

    return kernel
