"""The D3Q19 and D3Q27 lattices and the parameters of a lid-driven cavity."""

from __future__ import annotations

from dataclasses import dataclass

#: The nine directions of D3Q19 that go first, the centre, and weights by the number of axes moved along.
GOING = ((-1, 0, 0), (0, -1, 0), (0, 0, -1), (-1, -1, 0), (-1, 1, 0), (-1, 0, -1), (-1, 0, 1), (0, -1, -1), (0, -1, 1))
CENTER = 9
WEIGHTS_19 = {0: 1 / 3, 1: 1 / 18, 2: 1 / 36}
WEIGHTS_27 = {0: 8 / 27, 1: 2 / 27, 2: 1 / 54, 3: 1 / 216}

C19 = (*GOING, (0, 0, 0), *(tuple(-a for a in c) for c in GOING))
W19 = tuple(WEIGHTS_19[sum(map(abs, c))] for c in C19)
OPPOSITE_19 = tuple(C19.index(tuple(-a for a in c)) for c in C19)

C27 = tuple((a, b, c) for a in (0, -1, 1) for b in (0, -1, 1) for c in (0, -1, 1))
W27 = tuple(WEIGHTS_27[sum(map(abs, c))] for c in C27)
OPPOSITE_27 = tuple(C27.index(tuple(-a for a in c)) for c in C27)


@dataclass(frozen=True)
class Cavity:
    """A cube of n cells a side, its lid at the largest y moving along x."""

    n: int
    reynolds: float = 100.0
    lid: float = 0.04

    @property
    def viscosity(self) -> float:
        return self.lid * (self.n - 2) / self.reynolds

    @property
    def omega(self) -> float:
        return 1.0 / (3.0 * self.viscosity + 0.5)

    @property
    def dx(self) -> float:
        return 1.0 / (self.n - 2)

    @property
    def dt(self) -> float:
        return self.dx * self.lid
