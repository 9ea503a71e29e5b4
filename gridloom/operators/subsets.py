"""Fields on a subset of an outer grid's cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.spec import COORDS


def pull(subset: DataFrame, outer: DataFrame, column: str) -> DataFrame:
    """subset <- outer"""
    kept = [c for c in subset.columns if c != column]
    return subset.select(*kept).join(outer.select(*COORDS, column), list(COORDS))


def push(subset: DataFrame, outer: DataFrame, column: str) -> DataFrame:
    """outer <- subset; outer cells that aren't in the subset keep their values."""
    new = subset.select(*COORDS, F.col(column).alias("_new"), F.lit(True).alias("_in"))
    joined = outer.join(new, list(COORDS), "left")
    return joined.withColumn(column, F.when(F.col("_in"), F.col("_new")).otherwise(F.col(column))).select(*outer.columns)
