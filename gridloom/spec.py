"""Grids and stencils: small driver-side values that DataFrame operators are built from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

COORDS = ("x", "y", "z")
Offset = tuple[int, int, int]


@dataclass(frozen=True)
class Stencil:
    """An ordered list of offsets; a neighbour's number is its place in the list."""

    offsets: tuple[Offset, ...]

    def __len__(self) -> int:
        return len(self.offsets)

    def __iter__(self):
        return iter(self.offsets)

    def without_center(self) -> Stencil:
        return Stencil(tuple(o for o in self.offsets if o != (0, 0, 0)))

    def find(self, offset: Offset) -> int:
        return self.offsets.index(offset) if offset in self.offsets else -1

    def add(self, offset: Offset) -> Stencil:
        return self if offset in self.offsets else Stencil((*self.offsets, offset))

    def radius(self) -> int:
        """Chebyshev radius."""
        return max((max(map(abs, o)) for o in self.offsets), default=0)

    @staticmethod
    def union(*stencils: Stencil) -> Stencil:
        """Ordered, without repetition."""
        return Stencil(tuple(dict.fromkeys(o for s in stencils for o in s.offsets)))


def _cross(reach: int) -> tuple[Offset, ...]:
    """Offsets of the unit cube that leave the centre along at most `reach` axes, the zero of each axis first."""
    steps = (0, -1, 1)
    cube = ((a, b, c) for a in steps for b in steps for c in steps)
    return tuple(o for o in cube if sum(map(abs, o)) <= reach)


S7 = Stencil(_cross(1))
S6 = S7.without_center()
S19 = Stencil(_cross(2))
S27 = Stencil(tuple((a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)))
MOORE = Stencil(tuple((a, b, 0) for a in (-1, 0, 1) for b in (-1, 0, 1)))


@dataclass(frozen=True)
class GridSpec:
    """A box of cells. nz may be open (None) where the data decide it."""

    nx: int
    ny: int
    nz: int | None = None
    spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    stencil: Stencil = S7

    @property
    def size(self) -> int:
        if self.nz is None:
            raise ValueError("this grid's height is open")
        return self.nx * self.ny * self.nz

    def coords(self, key: Column) -> list[Column]:
        """x, y, z of a linear index."""
        plane = self.nx * self.ny
        return [
            (key % self.nx).cast("int").alias("x"),
            (F.floor(key / self.nx) % self.ny).cast("int").alias("y"),
            F.floor(key / plane).cast("int").alias("z"),
        ]

    def pitch(self, x: Column | str = "x", y: Column | str = "y", z: Column | str = "z") -> Column:
        """The linear index, as a BIGINT."""
        x, y, z = (F.col(c) if isinstance(c, str) else c for c in (x, y, z))
        return x.cast("long") + y.cast("long") * self.nx + z.cast("long") * self.nx * self.ny

    def inside(self, x: Column, y: Column, z: Column) -> Column:
        box = (x >= 0) & (x < self.nx) & (y >= 0) & (y < self.ny) & (z >= 0)
        return box if self.nz is None else box & (z < self.nz)
