"""Flow to the steady state: steps on a packed table until velocities hardly change, which is gathered while the last step of a round is written."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from gridloom.lbm.lattice import C19
from gridloom.lbm.uniform import BULK, PULLED, relax, run_packed, sent
from gridloom.operators import packed


@dataclass(frozen=True)
class Settled:
    """How a run ended: steps taken, and the mean change of velocity per fluid cell in the last of them."""

    steps: int
    change: float
    steady: bool


def velocities(f: np.ndarray) -> np.ndarray:
    """Of fluid cells [cell, population]."""
    return f @ np.array(C19, float) / f.sum(1, keepdims=True)


def watched(omega: float) -> packed.Kernel:
    """A step that also sums up, per block, the fluid cells and how much their velocities change."""
    step = relax(omega)

    def kernel(h: packed.Halo) -> dict[str, np.ndarray]:
        made = step(h)
        fluid = h.at(None) & (h.at("kind") == BULK)
        moved = np.zeros(fluid.shape)
        moved[fluid] = np.abs(velocities(made["f"][fluid]) - velocities(h.at("f")[fluid])).sum(1)
        count = fluid.reshape(len(fluid), -1).sum(1)
        return made | {"moved": moved.reshape(len(moved), -1).sum(1), "fluid": count.astype(float)}

    return kernel


def settle(table: packed.Packed, omega: float, tolerance: float, most: int, every: int = 20) -> tuple[packed.Packed, Settled]:
    """Steps until the mean change of velocity in one of them is below the tolerance, looked at every so many steps, or `most` steps are taken.

    The table given stays, those in between are dropped. A grid without fluid is steady at once.
    """
    if every < 1 or most < 1:
        raise ValueError("steps must be positive")
    first, steps, change = table, 0, float("inf")
    while steps < most:
        plain = min(every, most - steps) - 1
        for part in ("plain", "watched"):
            if part == "plain":
                after = run_packed(table, omega, plain) if plain else table
            else:
                after, seen = packed.step_with_totals(table, watched(omega), [table.field("f")], ["f"], PULLED, sent, ["kind", "wall"], ["kind", "wall"], ["moved", "fluid"])
            if after is not table and table is not first:
                table.drop()
            table = after
        steps += plain + 1
        change = seen["moved"] / seen["fluid"] if seen["fluid"] else 0.0
        if change < tolerance:
            return table, Settled(steps, change, True)
    return table, Settled(steps, change, False)
