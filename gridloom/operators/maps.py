"""Operators on one cell at a time. Each returns Columns or a projection; none shuffles."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fill(columns: Iterable[str], value: float) -> dict[str, Column]:
    return {c: F.lit(value) for c in columns}


def copy(source: str, target: str) -> dict[str, Column]:
    return {target: F.col(source)}


def axpy(a: Column | float, x: str, y: str) -> dict[str, Column]:
    """y += a x"""
    return {y: F.col(y) + a * F.col(x)}


def xpy(x: str, y: str) -> dict[str, Column]:
    return {y: F.col(y) + F.col(x)}


def add(x: str, y: str, z: str) -> dict[str, Column]:
    """z = x + y"""
    return {z: F.col(x) + F.col(y)}


def xpypz(x: str, y: str, z: str) -> dict[str, Column]:
    """z += x + y"""
    return {z: F.col(z) + F.col(x) + F.col(y)}


def scale(a: Column | float, x: str, out: str) -> dict[str, Column]:
    return {out: a * F.col(x)}


def ainv_xpy(a: float, x: str, y: str) -> dict[str, Column]:
    """y += x / a; a = 0 is an error, not an infinity."""
    if not isinstance(a, Column) and a == 0:
        raise ZeroDivisionError("a must not be 0")
    return {y: F.col(y) + (F.lit(1.0) / a) * F.col(x)}


def subtract(r: str, s: str) -> dict[str, Column]:
    return {r: F.col(r) - F.col(s)}


def init_residual(boundary: str, b: str, x: str, r: str) -> dict[str, Column]:
    """r = b where the cell is free (boundary = 1), else x."""
    return {r: F.when(F.col(boundary) == 1, F.col(b)).otherwise(F.col(x))}


def update_x_and_r(delta_new: Column, p_ap: Column, x: str, r: str, p: str, s: str) -> dict[str, Column]:
    alpha = delta_new / p_ap
    return {x: F.col(x) + alpha * F.col(p), r: F.col(r) - alpha * F.col(s)}


def update_p(delta_new: Column, delta_old: Column, r: str, p: str, eps: float = 1e-20) -> dict[str, Column]:
    beta = F.when(F.abs(delta_old) > eps, delta_new / delta_old).otherwise(F.lit(0.0))
    return {p: F.col(r) + beta * F.col(p)}


def expand_level_set(field: str, a: float) -> dict[str, Column]:
    return {field: F.col(field) - a}


def guarded(condition: Column, updates: dict[str, Column]) -> dict[str, Column]:
    """Updates where the condition holds; other cells keep their values."""
    return {c: F.when(condition, new).otherwise(F.col(c)) for c, new in updates.items()}


def cast_read(column: str, dtype: str) -> Column:
    return F.col(column).cast(dtype)


def apply(field: DataFrame, *updates: dict[str, Column]) -> DataFrame:
    """One projection per update, in order; the optimizer collapses them."""
    for u in updates:
        field = field.withColumns(u)
    return field


def swap(field: DataFrame, a: str, b: str) -> DataFrame:
    """Exchanges two columns by name; no data moves."""
    names = {a: b, b: a}
    return field.select(*[F.col(c).alias(names.get(c, c)) for c in field.columns])


def julia(nx: int, t: float, steps: int = 50, limit: float = 20.0) -> Column:
    """Shade of a Julia set at x, y: 1 - 0.02 per step taken before the norm passes the limit."""
    import math

    re, im = -0.8, 0.2 * math.cos(0.03 * t)
    start = F.struct(
        (2.0 * (F.col("x") / F.lit(float(nx)) - 1.0)).alias("a"), (2.0 * (F.col("y") / F.lit(float(nx)) - 0.5)).alias("b"), F.lit(0).alias("n")
    )

    def step(s: Column, _: Column) -> Column:
        a, b = s["a"], s["b"]
        going = F.sqrt(a * a + b * b) < limit
        na = F.when(going, a * a - b * b + re).otherwise(a)
        nb = F.when(going, 2.0 * a * b + im).otherwise(b)
        return F.struct(na.alias("a"), nb.alias("b"), (s["n"] + going.cast("int")).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: 1.0 - 0.02 * s["n"])
