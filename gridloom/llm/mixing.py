"""Mixing sources to target weights by systematic sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import id_ranks, keyed, materialize, require

#: Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from sizes(source, source_size), one row per source.

    Sources in the order of their code points, null last, take the weights in turn. A source's target is its weight times
    a level, at most `most` times its size; the level is the one at which all targets add up to `share` of all sizes. It
    is found in closed form: sources in the order in which a rising level fills them, and the first of them that the
    remaining words do not fill.
    """
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_w", turn.cast("double")).withColumn("_cap", F.col("source_size") * F.lit(most))
    by_level = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_filled", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("_open", F.sum("_w").over(W.partitionBy()) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    rows = rows.withColumn("_all", F.sum("source_size").over(W.partitionBy()) * F.lit(share))
    level = (F.col("_all") - F.col("_filled")) / F.col("_open")
    rows = rows.withColumn("_level", F.when(level * F.col("_w") <= F.col("_cap"), level))
    rows = rows.withColumn("_level", F.max("_level").over(W.partitionBy()))
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("_w")))
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, key: str | None = None) -> DataFrame:
    """Every row of docs(doc_id, text, source) with its size in words, its source's size and target, and its copies.

    A source's documents all expect target / source_size copies. They are put in order by size, then id (null last); the
    running sum of expected copies starts at an offset that depends on the seed and the source alone, and a document is
    taken once for each whole number that the sum passes in it: never more than `most` (rounded up) times. The order by
    size keeps a source's taken words within about one document of its target. Ties between equal rows are settled in
    any order, with equal results. A null text has size 0, a null source is a source of its own, null ids are kept, an
    empty table gives no rows. Other columns are dropped, but for `key`, a column that tells rows apart.
    """
    require(docs, "doc_id", "text", "source")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words(F.col("text")).alias("size"), *([F.col(key).alias("_key")] if key else []))
    sized = materialize(sized, "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, share, most).withColumnRenamed("source", "_source")
    ranked = id_ranks(sized, ["source"], ["size", "doc_id", *(["_key"] if key else [])], "_rank")
    ranked = ranked.join(targets, ranked["source"].eqNullSafe(targets["_source"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("\0"))).cast("binary")), 1, 4)
    offset = F.conv(digits, 16, 10).cast("double") / 65536.0
    rank = F.col("_rank").cast("double")
    passed = F.floor((rank + 1.0) * rate + offset) - F.floor(rank * rate + offset)
    copies = F.least(passed, F.floor(F.lit(float(most)))).cast("int")
    named = [F.col("_key").alias(key)] if key else []
    out = ranked.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), *named)
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs(doc_id, text, source, ...), each as often as mix takes it (options are those of mix).

    Rows get numbers of their own, so repeated rows and rows without an id are each taken as often
    as their own share says. Null texts and texts without words may be taken too, a null source is one of its own, an empty table
    gives no rows. All columns come back as they were, whatever their names.
    """
    require(docs, "doc_id", "text", "source")
    names = [f"c{i}" for i in range(len(docs.columns))]
    numbered = keyed(docs)
    at = {c: F.col(names[docs.columns.index(c)]).alias(c) for c in ("doc_id", "text", "source")}
    copies = mix(numbered.select(*at.values(), "key"), key="key", **options).filter("copies > 0").select(F.col("key").alias("k"), "copies")
    taken = numbered.join(copies, F.col("key") == F.col("k")).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*names).toDF(*docs.columns)


def mix_sql(seed: str = "mix", weights: tuple[int, ...] = WEIGHTS) -> str:
    """DuckDB SQL for the query's rows."""
    turn = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(weights))
    return f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {turn} END::DOUBLE AS w FROM totals
), filled AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_cap,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_w,
    (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS all_words FROM weighed
), levels AS (
  SELECT max((all_words - before_cap) / open_w) AS level FROM filled WHERE (all_words - before_cap) / open_w * w <= cap
), targets AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM filled, levels
), ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    (row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS LAST) - 1)::DOUBLE AS rank,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('{seed}:' || coalesce(s.source, chr(0))), 1, 4))::BIGINT::DOUBLE / 65536.0 AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(least(floor((rank + 1) * rate + start) - floor(rank * rate + start), 2) AS BIGINT) * size AS taken FROM ranked
"""
