"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialize


def _hook(edges: DataFrame, keep_smaller: bool) -> DataFrame:
    """One star operation on edges(a, b): links each neighbour that qualifies to the smallest of its star.

    The minimum is summed up before the shuffle and joined back. That join deals a hub's links by the hub, row by row; the adaptive
    skew join splits such a partition where it grows large.
    """
    both = edges if keep_smaller else edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(least, both["a"] == least["u"])
    if keep_smaller:
        linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
    else:
        linked = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.filter("a <> b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label: for every node of links(a, b) of two longs, the smallest node that it reaches.

    Large-star and small-star operations alternate until nothing changes, a number of rounds that grows with the
    logarithm of the number of nodes; each round is written to the shared folder. Nodes without links don't appear.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    for _ in range(rounds):
        large = _hook(edges, keep_smaller=False)
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        edges = materialize(_hook(large, keep_smaller=True), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
