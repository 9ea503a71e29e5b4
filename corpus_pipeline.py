"""From raw documents to packed training sequences: five stages, each applied to all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import jaccard, mixing, packing, quality, suffix
from gridloom.llm.common import WRITTEN, keyed, materialize, sweep, table

TOKENIZER = "byte_bpe_50k.json"


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with its columns as c0, c1, ... and a key for each row; and doc_id, text, lang and key."""
    rows = keyed(docs)
    named = [F.col(f"c{docs.columns.index(c)}").alias(c) for c in ("doc_id", "text", "lang")]
    return rows, rows.select(*named, "key")


def kept(docs: DataFrame, rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs whose key is in keys(key)."""
    return rows.join(keys.select(F.col("key").alias("_kept")), F.col("key") == F.col("_kept"), "left_semi").drop("key").toDF(*docs.columns)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose perplexity is above the limit of their language, null and empty texts among them.

    Every row is judged on its own text, repeated ids and missing ids included; a null language is one of its own. An empty table
    gives no rows. All columns come back as they were.
    """
    rows, named = numbered(docs)
    judged = quality.classify(named, table(spark, sf_dir, "labels").filter("quality = 1 AND coalesce(toxic, 0) = 0"), key="key")
    return kept(docs, rows, judged.filter("keep"))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that is linked by a similarity of 0.8 on five-word shingles: the one of smallest id.

    Of repeated rows of that id the first stays; rows without an id come after all others. Null and empty texts are linked with nothing
    and stay. An empty table gives no rows. All columns come back as they were.
    """
    rows, named = numbered(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    classes = jaccard.similarity_classes(named.select(F.col("key").alias("doc_id"), "text"), 5, 80).select(F.col("doc_id").alias("k"), "component_id")
    placed = classes.join(named.select("doc_id", "key"), F.col("k") == F.col("key"))
    return kept(docs, rows, placed.groupBy("component_id").agg(F.min(order)["key"].alias("key")))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every passage of 50 bytes or more that an earlier document has; what it leaves nothing of goes.

    A cut starts and ends between characters, and what was on its two sides is parted by a space unless white space parts it
    already. Null and empty texts stay; rows of equal ids don't cut each other; rows without an id come after all others.
    An empty table gives no rows. All columns but text and n_chars come back as they were, whatever their names.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: names[docs.columns.index(c)] for c in ("doc_id", "text", "n_chars") if c in docs.columns}
    given = docs.toDF(*names).withColumnsRenamed({at["doc_id"]: "doc_id", at["text"]: "text"})
    cut = suffix.remove_repeats(given, 50, joiner=" ").filter("n_bytes = 0 OR n_removed < n_bytes")
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept").cast("string"))
    cut = cut.withColumn("text", text).filter("n_removed = 0 OR trim(text) <> ''").withColumnsRenamed({"doc_id": at["doc_id"], "text": at["text"]})
    if "n_chars" in at:
        size = F.coalesce(F.length(at["text"]), F.lit(0))
        cut = cut.withColumn(at["n_chars"], F.when(F.col("n_removed") > 0, size.cast(docs.schema["n_chars"].dataType)).otherwise(F.col(at["n_chars"])))
    return cut.select(*names).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every row as often as its source's target asks for; repeated rows and rows without an id each count on their own.

    A null source is one of its own, a null text has no words. An empty table gives no rows. All columns come back as they were.
    """
    return mixing.emit(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every row into sequences of at most 1024 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is packed as an empty one (its end id alone), repeated rows once each, null ids are kept, other columns are
    left out, and an empty table gives no rows.
    """
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), 1024, 2)


STAGES = [
    ("quality classifier", classify_quality),
    ("n-gram Jaccard join", join_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The stages read hashes and trained models, which SQL doesn't express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, in order. What a stage wrote on its way is deleted as soon as its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        since = len(WRITTEN)
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        sweep(spark, since, WRITTEN[-1])
    return docs
