"""Conjugate gradients for the Poisson problem on a grid.

The state (u, r, w = A r, p, s = A p, boundary, b) lies in a packed block table. The recurrence is that with a single reduction: both sums
that an iteration needs belong to the new residual, so they are gathered while the new state is written. An iteration is one write,
which shuffles nothing but faces, and survives lost executors; the table before it is dropped.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import packed
from gridloom.spec import COORDS


@dataclass(frozen=True)
class Parameters:
    max_iterations: int = 100
    relative: float = 1e-5
    absolute: float = 0.0
    divergence: float = 1e5
    #: Compare r.r with relative x |r0|, and stop one iteration before the limit.
    compatible: bool = False


@dataclass(frozen=True)
class Result:
    status: str
    iterations: int
    residual: float
    start: float


def status(residual: float, start: float, iteration: int, p: Parameters) -> str | None:
    """converged, error or limit; None to go on."""
    if math.isnan(residual):
        return "error"
    if residual < max(p.relative * start, p.absolute):
        return "converged"
    if residual > p.divergence * start:
        return "error"
    if iteration >= p.max_iterations - p.compatible:
        return "limit"
    return None


def applied(h: packed.Halo, values: np.ndarray, spacing: float) -> np.ndarray:
    """(count x center - sum of neighbours) / h^2 of a wide box, in free cells; 0 in fixed ones."""
    wide = packed.Halo({"a": np.where(h.valid, values, 0.0)}, h.valid, h.size, h.radius)
    total, count = packed.sums(wide, "a")
    return np.where(h.at("bd") == 1, (count * wide.at("a") - total) / (spacing * spacing), 0.0)


def by_block(a: np.ndarray) -> np.ndarray:
    return a.reshape(len(a), -1).sum(1)


STATE = tuple(packed.Field(c, "double") for c in ("u", "r", "w", "p", "s"))


def begin(spacing: float) -> packed.Kernel:
    """The first residual, b - A u in free cells; everything else is 0 yet."""

    def kernel(h: packed.Halo) -> dict[str, np.ndarray]:
        r = np.where(h.at("bd") == 1, h.at("b") - applied(h, h.values["u"], spacing), 0.0)
        r = np.where(h.at(None), r, 0.0)
        none = np.zeros_like(r)
        return {"u": h.at("u"), "r": r, "w": none, "p": none, "s": none, "rr": by_block(r * r)}

    return kernel


def advance(alpha: float, beta: float, spacing: float) -> packed.Kernel:
    """p = r + beta p, s = w + beta s, u += alpha p, r -= alpha s, then w = A r; halos take part, so that r need not be sent twice."""

    def kernel(h: packed.Halo) -> dict[str, np.ndarray]:
        p = h.at("r") + beta * h.at("p")
        wide_s = h.values["w"] + beta * h.values["s"]
        wide_r = h.values["r"] - alpha * wide_s
        inner = packed.Halo({"r": wide_r, "s": wide_s}, h.valid, h.size, h.radius)
        r, w = inner.at("r"), np.where(h.at(None), applied(h, wide_r, spacing), 0.0)
        return {"u": h.at("u") + alpha * p, "r": r, "w": w, "p": p, "s": inner.at("s"), "rr": by_block(r * r), "rw": by_block(r * w)}

    return kernel


def solve(field: DataFrame, u: str = "u", b: str = "b", boundary: str = "boundary", h: float = 1.0, parameters: Parameters | None = None, size: int = packed.SIZE) -> tuple[DataFrame, Result]:
    """solve_packed, with x, y, z and u of every cell."""
    state, end = solve_packed(field, u, b, boundary, h, parameters, size)
    return packed.unpack(state, ["u"]), end


def solve_packed(field: DataFrame, u: str = "u", b: str = "b", boundary: str = "boundary", h: float = 1.0, parameters: Parameters | None = None, size: int = packed.SIZE, buckets: int | None = None) -> tuple[packed.Packed, Result]:
    """Solves (count x u - sum of neighbours) / h^2 = b in free cells (boundary = 1); fixed cells keep their u.

    Returns a packed table with u, b and bd (the boundary), and how the iteration ended. A search direction without curvature (0, or not a number) before the residual is
    small enough is an error: the system has no solution, or its numbers no meaning. An empty grid converges at once.
    """
    prm = parameters or Parameters()
    cells = field.select(*COORDS, F.col(u).cast("double").alias("u"), F.col(b).cast("double").alias("b"), F.col(boundary).cast("int").alias("bd"))
    given = packed.pack(cells, ["u", "b", "bd"], size, buckets=buckets)
    state, seen = packed.step_with_totals(given, begin(h), STATE, ["u"], keep=["bd", "b"], own=["b", "bd"], totals=["rr"])
    given.drop()

    def move(alpha: float, beta: float) -> dict[str, float]:
        nonlocal state
        after, sums = packed.step_with_totals(state, advance(alpha, beta, h), STATE, ["r", "w", "s"], keep=["bd", "b"], own=["u", "p", "bd"], totals=["rr", "rw"])
        state.drop()
        state = after
        return sums

    start = math.sqrt(seen["rr"])
    if start < 1e-30:
        return state, Result("converged", 0, start, start)
    seen, residual, done, iteration = move(0.0, 0.0), start, None, 0
    alpha, beta = 0.0, 0.0
    while done is None:
        curvature = seen["rw"] - (beta * seen["rr"] / alpha if iteration else 0.0)
        if not curvature or math.isnan(curvature):
            return state, Result("error", iteration + 1, residual, start)
        iteration += 1
        before, alpha = seen["rr"], seen["rr"] / curvature
        seen = move(alpha, beta)
        beta = seen["rr"] / before
        residual = seen["rr"] if prm.compatible else math.sqrt(seen["rr"])
        done = status(residual, start, iteration, prm)
        if done is None and not seen["rr"]:
            done = "converged"
    return state, Result(done, iteration, residual, start)
