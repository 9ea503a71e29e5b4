"""Files for other tools: VTK grids, centre-line profiles, run reports.

Grid values are encoded on the executors, some rows of a plane at a time; the driver only puts the pieces in order into the file.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator, Sequence
from itertools import groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from gridloom.operators.partitions import dense_slab
from gridloom.plans.checkpoint import cut
from gridloom.spec import COORDS, GridSpec


#: How the values of a cell are written: lines of text, big-endian or little-endian doubles.
TEXT, BIG, LITTLE = "text", ">f8", "<f8"
CHUNK = 65536


def encode(values: np.ndarray, form: str) -> bytes:
    """Values [cell, component] as a file holds them."""
    if form == TEXT:
        return "".join(" ".join(f"{v:.17g}" for v in row) + "\n" for row in values.tolist()).encode()
    return values.astype(form).tobytes()


def encoded(field: DataFrame, grid: GridSpec, columns: Sequence[str], form: str = TEXT, outside: float = 0.0) -> DataFrame:
    """z, chunk, data: the encoded cells of some whole rows of a plane, x fastest, where the field has cells.

    Made on the executors, about CHUNK cells at a time; inactive cells have the outside value.
    """
    rows, nx, ny, n = max(1, CHUNK // grid.nx), grid.nx, grid.ny, len(columns)

    def run(table: pa.Table) -> pa.Table:
        z, chunk = table.column(0)[0].as_py(), table.column(1)[0].as_py()
        box = np.full((min(rows, ny - chunk * rows), nx, n), outside)
        x, y = table.column(2).to_numpy(), table.column(3).to_numpy() - chunk * rows
        for i in range(n):
            box[y, x, i] = table.column(4 + i).to_numpy()
        return pa.table({"z": pa.array([z], pa.int32()), "chunk": pa.array([chunk], pa.int32()), "data": pa.array([encode(box.reshape(-1, n), form)], pa.binary())})

    inside = field.filter(grid.inside(*map(F.col, COORDS)))
    keyed = inside.select("z", F.floor(F.col("y") / rows).cast("int").alias("chunk"), "x", "y", *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    return keyed.groupBy("z", "chunk").applyInArrow(run, "z int, chunk int, data binary")


def pieces(field: DataFrame, grid: GridSpec, columns: Sequence[str], form: str, outside: float) -> Iterator[bytes]:
    """The encoded box in order, those parts included that have no cells; the driver holds a partition of them at most."""
    rows = max(1, CHUNK // grid.nx)
    parts = -(-grid.ny // rows)

    def nothing(chunk: int) -> bytes:
        return encode(np.full((min(rows, grid.ny - chunk * rows) * grid.nx, len(columns)), outside), form)

    at = 0
    for r in encoded(field, grid, columns, form, outside).orderBy("z", "chunk").toLocalIterator():
        while at < r["z"] * parts + r["chunk"]:
            yield nothing(at % parts)
            at += 1
        yield bytes(r["data"])
        at += 1
    while at < grid.nz * parts:
        yield nothing(at % parts)
        at += 1


def in_base64(data: Iterator[bytes]) -> Iterator[bytes]:
    left = b""
    for part in data:
        left += part
        whole = len(left) // 3 * 3
        yield base64.b64encode(left[:whole])
        left = left[whole:]
    yield base64.b64encode(left)


def write_vtk(path: str, field: DataFrame, grid: GridSpec, fields: dict[str, Sequence[str]], node: bool = False, binary: bool = False, outside: float = 0.0) -> None:
    """Legacy VTK structured points. fields: a name and the columns of its components; one column is a scalar, three a vector.

    Cells are voxels unless node is set; voxel data sits between nodes, of which there is one more along each axis.
    """
    points = [n + (not node) for n in (grid.nx, grid.ny, grid.nz)]
    with Path(path).open("wb") as out:
        head = ["# vtk DataFile Version 3.0", "gridloom", "BINARY" if binary else "ASCII", "DATASET STRUCTURED_POINTS"]
        head += [f"DIMENSIONS {points[0]} {points[1]} {points[2]}", "ORIGIN " + " ".join(f"{v:g}" for v in grid.origin), "SPACING " + " ".join(f"{v:g}" for v in grid.spacing)]
        head.append(f"{'POINT' if node else 'CELL'}_DATA {grid.size}")
        out.write(("\n".join(head) + "\n").encode())
        for name, columns in fields.items():
            kind = f"VECTORS {name} double" if len(columns) == 3 else f"SCALARS {name} double {len(columns)}\nLOOKUP_TABLE default"
            out.write((kind + "\n").encode())
            out.writelines(pieces(field, grid, columns, BIG if binary else TEXT, outside))
            if binary:
                out.write(b"\n")


def write_vti(path: str, field: DataFrame, grid: GridSpec, fields: dict[str, Sequence[str]], node: bool = False, outside: float = 0.0) -> None:
    """XML image data, values in base64 after their length in bytes."""
    n = [v - node for v in (grid.nx, grid.ny, grid.nz)]
    extent = f"0 {n[0]} 0 {n[1]} 0 {n[2]}"
    section = "PointData" if node else "CellData"
    with Path(path).open("wb") as out:
        out.write(b'<?xml version="1.0"?>\n<VTKFile type="ImageData" version="0.1" byte_order="LittleEndian" header_type="UInt64">\n')
        out.write(f'<ImageData WholeExtent="{extent}" Origin="{" ".join(f"{v:g}" for v in grid.origin)}" Spacing="{" ".join(f"{v:g}" for v in grid.spacing)}">\n<Piece Extent="{extent}">\n<{section}>\n'.encode())
        for name, columns in fields.items():
            size = base64.b64encode(struct.pack("<Q", 8 * grid.size * len(columns)))
            out.write(f'<DataArray type="Float64" Name="{name}" NumberOfComponents="{len(columns)}" format="binary">\n'.encode() + size)
            out.writelines(in_base64(pieces(field, grid, columns, LITTLE, outside)))
            out.write(b"\n</DataArray>\n")
        out.write(f"</{section}>\n</Piece>\n</ImageData>\n</VTKFile>\n".encode())


def write_levels(path: str, cells: DataFrame, column: str, unrefined_only: bool = True) -> int:
    """Multi-resolution cells as hexahedra of a legacy VTK unstructured grid, with column and level; returns their number."""
    rows = cells.filter("NOT refined") if unrefined_only and "refined" in cells.columns else cells
    # The file holds the cells four times over, so they are written once and read in order for each section.
    kept = cut(rows.select("level", *COORDS, F.col(column).cast("double").alias("value")), "hexahedra")
    n = kept.count()

    def each() -> Iterator[Row]:
        return kept.orderBy("level", "z", "y", "x").toLocalIterator()

    corners = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))
    with Path(path).open("w") as out:
        out.write(f"# vtk DataFile Version 3.0\ngridloom\nASCII\nDATASET UNSTRUCTURED_GRID\nPOINTS {8 * n} double\n")
        for r in each():
            w = 1 << r["level"]
            out.writelines(f"{r['x'] + a * w} {r['y'] + b * w} {r['z'] + c * w}\n" for a, b, c in corners)
        out.write(f"CELLS {n} {9 * n}\n")
        out.writelines("8 " + " ".join(str(8 * i + k) for k in range(8)) + "\n" for i in range(n))
        out.write(f"CELL_TYPES {n}\n")
        out.writelines("12\n" for _ in range(n))
        out.write(f"CELL_DATA {n}\nSCALARS {column} double 1\nLOOKUP_TABLE default\n")
        out.writelines(f"{r['value']:.17g}\n" for r in each())
        out.write("SCALARS level int 1\nLOOKUP_TABLE default\n")
        out.writelines(f"{r['level']}\n" for r in each())
    return n


def write_domain(path: str, cells: DataFrame, grid: GridSpec, slabs: int, binary: bool = False) -> None:
    """The grid's domain field as VTK: the slab of each active cell, -1 elsewhere."""
    write_vtk(path, cells.select(*COORDS, dense_slab(grid.nz, slabs).alias("domain")), grid, {"domain": ["domain"]}, binary=binary, outside=-1.0)


def hexahedra(cells: DataFrame) -> DataFrame:
    """Eight corner rows (level, cell x y z, corner 0-7, px, py, pz) per unrefined cell, made on the executors."""
    corners = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip((k, *o), ("corner", "dx", "dy", "dz"), strict=True)]) for k, o in enumerate(corners)])
    rows = cells.filter("NOT refined") if "refined" in cells.columns else cells
    wide = F.call_function("shiftleft", F.lit(1), F.col("level"))
    out = rows.select("level", *COORDS, F.explode(table).alias("o"))
    return out.select("level", *COORDS, F.col("o.corner").alias("corner"), *[(F.col(c) + F.col(f"o.d{c}") * wide).cast("int").alias(f"p{c}") for c in COORDS])


def write_profile(path: str, profile: DataFrame) -> None:
    """pos and value pairs in the order of pos."""
    rows = sorted((float(r["pos"]), float(r["value"])) for r in profile.select("pos", "value").toLocalIterator())
    Path(path).write_text("".join(f"{p:.10g} {v:.10g}\n" for p, v in rows))


def write_report(path: str, members: dict) -> None:
    """A run's facts as JSON; dictionaries nest."""
    Path(path).write_text(json.dumps(members, indent=2, sort_keys=True, default=str) + "\n")


def planes(field: DataFrame, columns: Sequence[str]) -> Iterator[tuple[int, list]]:
    """Rows plane by plane, for writers that hold one plane only."""
    rows = field.select(*COORDS, *columns).orderBy("z", "y", "x").toLocalIterator()
    for z, part in groupby(rows, key=lambda r: r["z"]):
        yield z, list(part)
