"""Resampling towards a target: hashed n-gram buckets, gains of the target over the corpus, Gumbel scores and the best of them."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import id_ranks, keyed, materialize, require

BUCKETS, LEAST, PERCENT, SEED = 10_000, 20, 10, 2024


def words(text: Column) -> Column:
    """Runs of digits, ASCII letters (lower-cased) and anything beyond ASCII; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def features(tokens: Column, orders: int) -> Column:
    """All runs of 1 to `orders` consecutive words, joined by one space, repeats kept."""

    def runs(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))
        return F.when(F.size(tokens) >= n, each).otherwise(F.array().cast("array<string>"))

    return tokens if orders == 1 else F.concat(tokens, *map(runs, range(2, orders + 1)))


def bucketed(rows: DataFrame, carry: list[str], orders: int, buckets: int) -> DataFrame:
    """One row per feature of rows(tokens), with its bucket."""
    each = rows.select(*carry, F.explode(features(F.col("tokens"), orders)).alias("feature"))
    return each.select(*carry, F.pmod(F.crc32(F.col("feature").cast("binary")), F.lit(buckets)).cast("int").alias("bucket"))


def bucket_counts(texts: DataFrame, orders: int, buckets: int, out: str) -> DataFrame:
    """bucket, out: how many features of all texts(tokens) fall into each bucket; summed up before the one shuffle."""
    return bucketed(texts, [], orders, buckets).groupBy("bucket").agg(F.count(F.lit(1)).alias(out))


def gains(docs: DataFrame, target: DataFrame, orders: int, buckets: int) -> DataFrame:
    """bucket, gain for each bucket that docs(tokens) have: floor(1000 ln of the target's share over the corpus's, each count plus one)."""
    s = bucket_counts(docs, orders, buckets, "s")
    t = bucket_counts(target, orders, buckets, "t")
    counts = materialize(s.join(t, "bucket", "full").select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"]), "buckets")
    total = counts.agg(F.coalesce(F.sum("s"), F.lit(0.0)), F.coalesce(F.sum("t"), F.lit(0.0))).first()
    up = (F.col("t") + 1) * F.lit(total[0] + buckets)
    down = (F.col("s") + 1) * F.lit(total[1] + buckets)
    return counts.filter("s > 0").select(F.col("bucket").alias("b"), F.floor(1000 * F.log(up / down)).cast("long").alias("gain"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 x a Gumbel variate), drawn from a hash of the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    orders: int = 1,
    buckets: int = BUCKETS,
    least: int = LEAST,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, n_words, weight, score, rank for every document; rank is null where it isn't drawn.

    weight sums the gains of a document's features; score adds Gumbel noise, so that the highest scores are a sample without
    replacement in proportion to exp(weight / 1000). Of the documents with `least` words or more, `percent` in a hundred
    (rounded down) are drawn, ties to the smaller id.

    A null text counts as empty: no features, weight 0, never drawn. A null id draws the noise of the word null and loses
    ties; repeated rows or ids are ranked as rows of their own, in any order where score and id are equal. Empty tables of
    documents give no rows, an empty target makes every gain that of counts of 0. Other columns are ignored.

    The features of a document are exploded and summed up where it was read, so one row per document is shuffled; the
    gains have at most `buckets` rows, which bounds the broadcast. Ranks come from ranges of the order, not from one window.
    """
    require(docs, doc_id, text)
    require(target, target_text)
    if orders < 1 or buckets < 1:
        raise ValueError("orders and buckets must be positive")
    rows = keyed(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))).toDF("doc_id", "text", "key")
    rows = rows.select("key", "doc_id", words(F.col("text")).alias("tokens"))
    gain = gains(rows, target.select(words(F.col(target_text)).alias("tokens")), orders, buckets)
    # The empty mark keeps documents without features among the rows.
    marked = rows.select("key", "doc_id", F.size("tokens").cast("long").alias("n"), F.explode_outer(features(F.col("tokens"), orders)).alias("feature"))
    marked = marked.withColumn("bucket", F.pmod(F.crc32(F.col("feature").cast("binary")), F.lit(buckets)).cast("int"))
    each = marked.join(F.broadcast(gain), F.col("bucket") == F.col("b"), "left")
    sums = each.groupBy("key", "doc_id").agg(F.max("n").alias("n_words"), F.count("feature").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    scored = sums.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = materialize(scored.select("doc_id", "n_features", "n_words", "weight", "score", (F.col("n_words") < least).alias("short"), (-F.col("score")).alias("low")), "scores")
    take = scored.filter(~F.col("short")).count() * percent // 100
    ranked = id_ranks(scored, [], ["short", "low", "doc_id"], "place")
    return ranked.select("doc_id", "n_features", "n_words", "weight", "score", F.when(F.col("place") < take, F.col("place") + 1).cast("long").alias("rank"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: DuckDB has no crc32: it is folded here byte by byte and bit by bit, once for each distinct word.
_CRC = """xor(4294967295, list_reduce(list_transform(range(octet_length(encode(w))), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT)),
 lambda c, b: list_reduce(range(8), lambda d, k: CASE WHEN d % 2 = 1 THEN xor(d // 2, 3988292384) ELSE d // 2 END, xor(c, b)), 4294967295))"""
RESAMPLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS ws FROM documents),
m AS MATERIALIZED (SELECT {_WORDS} AS ws FROM benchmark),
dw AS MATERIALIZED (SELECT k, unnest(ws) AS w FROM d), mw AS MATERIALIZED (SELECT unnest(ws) AS w FROM m),
crc AS MATERIALIZED (SELECT w, {_CRC} % {BUCKETS} AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM mw)),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN crc USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM mw JOIN crc USING (w) GROUP BY bucket),
gain AS MATERIALIZED (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM mw) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain
 FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT k, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN crc USING (w) JOIN gain USING (bucket) GROUP BY k),
scored AS MATERIALIZED (SELECT k, doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
 coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN w USING (k)),
drawn AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE n_features >= {LEAST})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT {PERCENT} * count(*) // 100 FROM scored WHERE n_features >= {LEAST}) THEN rank END AS rank FROM scored LEFT JOIN drawn USING (k)
"""
