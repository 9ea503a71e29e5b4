"""Reductions over fields: one row per result, summed in part before the shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegralType, NumericType

from gridloom.plans.checkpoint import cut
from gridloom.spec import COORDS, GridSpec

#: What a BIGINT holds at most.
LARGEST = 2**63 - 1


def check_numbers(field: DataFrame, *columns: str) -> None:
    """Operands of a reduction must be numbers of one type."""
    kinds = {c: field.schema[c].dataType for c in columns}
    if not all(isinstance(k, NumericType) for k in kinds.values()) or len(set(kinds.values())) > 1:
        raise TypeError(f"not numbers of one type: {({c: k.simpleString() for c, k in kinds.items()})}")


def exact(field: DataFrame, column: str) -> Column:
    """A column to reduce: whole numbers with 38 digits, since products and sums of them outgrow a BIGINT."""
    c = F.col(column)
    return c.cast("decimal(19,0)") if isinstance(field.schema[column].dataType, IntegralType) else c


def total(value: Column) -> Column:
    """The sum, 0 without rows; exact() values keep their 38 digits."""
    return F.coalesce(F.sum(value), F.lit(0))


def narrowed(sums: DataFrame, column: str) -> DataFrame:
    """Few rows of whole sums, as BIGINT if all of them fit, else with the 38 digits that they need."""
    sums = cut(sums.withColumn(column, F.col(column).cast("decimal(38,0)")), "sums")
    large = not sums.filter(~F.col(column).between(-LARGEST - 1, LARGEST)).isEmpty()
    return sums if large else sums.withColumn(column, F.col(column).cast("long"))


def dot(field: DataFrame, a: str, b: str, out: str = "dot") -> DataFrame:
    check_numbers(field, a, b)
    return field.agg(total(exact(field, a) * exact(field, b)).alias(out))


def norm2(field: DataFrame, a: str, out: str = "norm2") -> DataFrame:
    check_numbers(field, a)
    return field.agg(F.sqrt(total(exact(field, a) * exact(field, a)).cast("double")).alias(out))


def absolute_sum(field: DataFrame, a: str, out: str = "abs_sum") -> DataFrame:
    check_numbers(field, a)
    return field.agg(total(F.abs(exact(field, a))).alias(out))


def in_range(field: DataFrame, grid: GridSpec, start: int, count: int) -> DataFrame:
    """The cells of a run of linear indices."""
    return field.filter((grid.pitch() >= start) & (grid.pitch() < start + count))


def check_same_grid(a: DataFrame, b: DataFrame) -> None:
    """Operands of a reduction must live on the same cells."""
    if grid_differences(a, b).limit(1).count():
        raise ValueError("the fields have different cells")


def grid_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """x, y, z and count: the cells that one field has more often than the other; positive where that is the first."""
    both = a.select(*COORDS, F.lit(1).alias("n")).unionByName(b.select(*COORDS, F.lit(-1).alias("n")))
    return both.groupBy(*COORDS).agg(F.sum("n").alias("count")).filter("count <> 0")


def reduce_with(field: DataFrame, column: str, op: np.ufunc, neutral: float, out: str = "value") -> DataFrame:
    """One row: a column folded by any associative and commutative NumPy operation; nulls are left out.

    Every partition folds its own batches to one row, and one task folds those rows.
    """
    check_numbers(field, column)
    kind = field.schema[column].dataType
    dtype = to_arrow_type(kind)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = neutral
        for b in batches:
            values = b.column(0).drop_null().to_numpy(zero_copy_only=False)
            if len(values):
                got = op(got, op.reduce(values))
        yield pa.RecordBatch.from_arrays([pa.array([got], dtype)], names=[out])

    schema = f"{out} {kind.simpleString()}"
    return field.select(column).mapInArrow(fold, schema).repartition(1).mapInArrow(fold, schema)


def by_view(field: DataFrame, value: Column, view: str = "data_view") -> DataFrame:
    """Sums per data view, and over all as STANDARD, from one aggregation."""
    rows = field.select(F.col(view).alias("v"), value.alias("_x"))
    sums = rows.rollup("v").agg(total(exact(rows, "_x")).alias("total"), F.grouping("v").alias("_g"))
    return sums.select(F.when(F.col("_g") == 1, F.lit("STANDARD")).otherwise(F.col("v")).alias(view), "total")


def counts(field: DataFrame, *keys: str) -> DataFrame:
    return field.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells"))


def scatter_add(rows: DataFrame, keys: list[str], value: str, out: str = "total") -> DataFrame:
    """What atomic additions to a target cell come to."""
    return rows.groupBy(*keys).agg(F.sum(value).alias(out))


def relative_error(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Largest |a - b| / max(|b|, tiny) over cells of both."""
    joined = a.select(*COORDS, F.col(column).alias("_a")).join(b.select(*COORDS, F.col(column).alias("_b")), list(COORDS))
    return joined.agg(F.max(F.abs(F.col("_a") - F.col("_b")) / F.greatest(F.abs("_b"), F.lit(1e-300)).cast("double")).alias("relative_error"))


def across(columns: list[str], how: str) -> Column:
    """Reductions of a vector's components: max, min, abs_max, sum, mul."""
    cols = [F.col(c) for c in columns]
    if how == "max":
        return F.greatest(*cols)
    if how == "min":
        return F.least(*cols)
    if how == "abs_max":
        return F.greatest(*[F.abs(c) for c in cols])
    if how == "sum":
        return reduce(lambda a, b: a + b, cols)
    if how == "mul":
        return reduce(lambda a, b: a * b, cols)
    raise ValueError(f"unknown reduction: {how}")
