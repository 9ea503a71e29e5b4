"""Document fingerprints: threshold-scaled sketches of word shingles, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import materialize, require, scan_parts

#: Hashes have so many bits; one in SCALE of all possible values is retained, but LEAST hashes of a text at least, if it has as many.
BITS, SCALE, WORDS, LEAST = 40, 8, 5, 16


def let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """The sorted distinct hashes of a text's shingles that lie below the threshold of 2^BITS / scale.

    Words are runs of anything but ASCII white space. A text of fewer words is one shingle as a whole, an empty one has
    none. Where fewer than LEAST hashes lie below the threshold, the LEAST smallest (all, if fewer) are retained, so short texts have a higher
    threshold of their own, which `bound` reads off the sketch. A union of texts' sketches, cut at the least of their bounds, holds
    every hash below it of the texts together.
    """
    split = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    value = lambda h: F.shiftrightunsigned(h, 64 - BITS)

    def hashes(w: Column) -> Column:
        whole = F.when(F.size(w) > 0, F.array(value(F.xxhash64(F.concat_ws(" ", w))))).otherwise(F.array().cast("array<bigint>"))
        long = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: value(F.xxhash64(*[F.get(w, i + k) for k in range(words)])))
        return F.when(F.size(w) >= words, long).otherwise(whole)

    def retain(h: Column) -> Column:
        low = F.array_sort(F.array_distinct(F.filter(h, lambda v: v < 2**BITS // scale)))
        return let(low, lambda x: F.when(F.size(x) >= LEAST, x).otherwise(F.slice(F.array_sort(F.array_distinct(h)), 1, LEAST)))

    return let(split, lambda w: let(hashes(w), retain))


def bound(a: Column, scale: int = SCALE) -> Column:
    """All hashes of a text that lie below this are in its sketch: a sketch of fewer than LEAST holds all, a larger one those up to its last or to the threshold."""
    return F.when(F.size(a) < LEAST, F.lit(2**BITS)).otherwise(F.greatest(F.element_at(a, -1) + 1, F.lit(2**BITS // scale)))


def compared(a: Column, b: Column, scale: int, then) -> Column:
    """then(hashes of a, hashes of b, both): each below the bounds of both sketches."""
    least = F.least(bound(a, scale), bound(b, scale))
    both = let(least, lambda m: F.array(F.filter(a, lambda v: v < m), F.filter(b, lambda v: v < m)))
    return let(both, lambda x: then(F.size(x[0]), F.size(x[1]), F.size(F.array_intersect(x[0], x[1]))))


def likeness(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated Jaccard similarity; two empty sketches are alike."""
    empty = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(empty, F.lit(1.0)).otherwise(compared(a, b, scale, lambda n, m, both: both / (n + m - both).cast("double")))


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share of a's shingles that b holds; an empty sketch is held by any, null where no hash of a lies below the bound of b."""
    share = compared(a, b, scale, lambda n, _, both: F.when(n > 0, both / n.cast("double")))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(share)


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda v: F.lpad(F.lower(F.hex(v)), BITS // 4, "0")), "")


def with_next(docs: DataFrame, id_col: str, text: str, columns: list[str]) -> DataFrame:
    """Adds next_<c> for each of columns: its value in the row with the next id (after the last: the first).

    Rows go by id (null last), then by a hash of the text, then the text. First ids and hashes alone are dealt by range; the least
    of each range (one number and one hash per range, not per document) are the bounds of the buckets in which
    whole rows meet. A row on a bound is also dealt to the bucket before it. So texts are shuffled once, and neither sparse ids
    nor a repeated or missing id crowd a bucket; only rows with equal ids and texts stay together.
    """
    spark = docs.sparkSession
    place = F.struct(F.col(id_col).isNull().alias("none"), F.coalesce(id_col, F.lit(0)).alias("id"), F.xxhash64(text).alias("h"))
    slim = docs.select(place.alias("p")).select("p.*")
    ranged = materialize(slim.repartitionByRange(scan_parts(spark), "none", "id", "h").withColumn("part", F.spark_partition_id()), "ranges")
    found = ranged.groupBy("part").agg(F.min(F.struct("none", "id", "h")).alias("p")).select("p.*").sort("none", "id", "h").collect()
    if not found:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    bounds = [F.struct(F.lit(r["none"]).alias("none"), F.lit(r["id"]).cast("long").alias("id"), F.lit(r["h"]).cast("long").alias("h")) for r in found]
    # Two steps, so that the comparisons per row grow with the square root of the number of buckets.
    step = max(1, int(len(bounds) ** 0.5))
    groups = F.array(*[F.array(*bounds[i : i + step]) for i in range(0, len(bounds), step)])
    passed = lambda list_, p: F.size(F.filter(list_, lambda b: b <= p))
    rows = docs.withColumn("_p", place)
    rows = rows.withColumn("_group", F.greatest(passed(F.array(*bounds[::step]), F.col("_p")) - 1, F.lit(0)))
    rows = rows.withColumn("_cut", F.col("_group") * step + F.greatest(passed(F.get(groups, F.col("_group")), F.col("_p")) - 1, F.lit(0)))
    first = F.get(F.array(*bounds), F.col("_cut")) == F.col("_p")
    own = F.struct(F.col("_cut").alias("cut"), F.lit(0).alias("guest"))
    guest = F.struct(F.pmod(F.col("_cut") - 1, F.lit(len(bounds))).alias("cut"), F.lit(1).alias("guest"))
    dealt = rows.withColumn("_at", F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own))))
    window = W.partitionBy("_at.cut").orderBy("_at.guest", "_p", F.col(text))
    led = dealt.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns])
    return led.filter("_at.guest = 0").drop("_cut", "_at", "_p", "_group")


def fingerprints(docs: DataFrame, words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Sketches of every whole text of docs(doc_id, text), of its edited form and of the next document's text.

    The edited form has the last quarter of the code points replaced by the first as many (or all) of the next document's
    text, by id. A null text counts as empty. Equal texts have equal fingerprints; repeated rows and repeated ids are rows
    of their own; null ids come last, by a hash of their texts; a lone document follows itself; an empty table gives no rows; other columns are
    ignored. Beside Jaccard likeness the containments of the text in the edited and the next one are given, null where the sketches can't tell.
    """
    require(docs, "doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.withColumn("s", sketch(F.col("t"), words, scale))
    rows = with_next(rows, "doc_id", "t", ["t", "s"]).withColumn("n_chars", F.length("t").cast("long"))
    moved = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("t", F.lit(1), F.col("n_chars").cast("int") - moved), F.substring("next_t", F.lit(1), moved))
    rows = rows.withColumn("edited", edited).withColumn("e", sketch(F.col("edited"), words, scale))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("s")).alias("fingerprint"),
        as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("e"), scale).alias("near_edited"),
        likeness(F.col("s"), F.col("next_s"), scale).alias("near_next"),
        containment(F.col("s"), F.col("e"), scale).alias("in_edited"),
        containment(F.col("s"), F.col("next_s"), scale).alias("in_next"),
    )
