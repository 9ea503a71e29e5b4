"""Functions on vectors held as three columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(*names: str) -> Vec:
    return tuple(F.col(n) for n in names)


def plus(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def minus(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def times(a: Vec, s: Column | float) -> Vec:
    return tuple(p * s for p in a)


def whole_divide(a: Vec, s: int) -> Vec:
    """Integer division that truncates toward zero."""
    return tuple((F.when(p >= 0, F.floor(p / s)).otherwise(F.ceil(p / s))).cast("long") for p in a)


def remainder(a: Vec, s: int) -> Vec:
    """The sign follows the dividend."""
    return tuple(p % s for p in a)


def negate(a: Vec) -> Vec:
    return tuple(-p for p in a)


def every(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def less(a: Vec, b: Vec) -> Column:
    """True only if it holds on every axis; the negation isn't greater-or-equal."""
    return every([p < q for p, q in zip(a, b, strict=True)])


def at_most(a: Vec, b: Vec) -> Column:
    return every([p <= q for p, q in zip(a, b, strict=True)])


def equal(a: Vec, b: Vec) -> Column:
    return every([p == q for p, q in zip(a, b, strict=True)])


def component_max(a: Vec, b: Vec) -> Vec:
    return tuple(F.greatest(p, q) for p, q in zip(a, b, strict=True))


def component_min(a: Vec, b: Vec) -> Vec:
    return tuple(F.least(p, q) for p, q in zip(a, b, strict=True))


def dot(a: Vec, b: Vec) -> Column:
    p = [x * y for x, y in zip(a, b, strict=True)]
    return p[0] + p[1] + p[2]


def norm_sq(a: Vec) -> Column:
    return dot(a, a)


def norm(a: Vec) -> Column:
    return F.sqrt(norm_sq(a).cast("double"))


def whole_norm(a: Vec) -> Column:
    """The norm of an integer vector, truncated."""
    return F.floor(norm(a)).cast("long")


def index_of_max(a: Vec) -> Column:
    """The first axis with the largest component."""
    return (F.array_position(F.array(*a), F.greatest(*a)) - 1).cast("int")


def index_of_min(a: Vec) -> Column:
    return (F.array_position(F.array(*a), F.least(*a)) - 1).cast("int")


def min_mask(a: Vec) -> Vec:
    """1 on the first axis with the smallest component, else 0."""
    return tuple((index_of_min(a) == k).cast("int") for k in range(3))


def order_by_max(a: Vec) -> Column:
    """Axes from the largest component to the smallest, ties by axis."""
    rows = F.array(*[F.struct((-p).alias("v"), F.lit(k).alias("k")) for k, p in enumerate(a)])
    return F.transform(F.array_sort(rows), lambda s: s["k"])


def zeros(a: Vec) -> Column:
    return sum(((p == 0).cast("int") for p in a), F.lit(0))


def set_bit(mask: Column, bit: int) -> Column:
    return mask.bitwiseOR(F.lit(1 << bit))


def has_bit(mask: Column, bit: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << bit)) != 0


def double_times(n: Column) -> Column:
    """2 to the power n, from scaling a double by a power of two."""
    return F.pow(F.lit(2.0), n)
