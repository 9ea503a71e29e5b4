"""Plumbing shared by the text operators: shared-folder tables, id-ordered ranks, blocks of documents."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a block at most, whatever their sizes.
BLOCK_ROWS = 8192


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode alone, a temporary one where it is unset."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("gridloom.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        spark.conf.set("gridloom.checkpoint.dir", path)
    return path.rstrip("/")


class Written(threading.local):
    """Paths of tables; each thread of the driver has a list of its own, so runs in several threads don't delete each other's."""

    def __init__(self):
        self.paths: list[str] = []

    def __len__(self) -> int:
        return len(self.paths)

    def __getitem__(self, at):
        return self.paths[at]

    def append(self, path: str) -> None:
        self.paths.append(path)

    def remove(self, path: str) -> None:
        self.paths.remove(path)


#: Tables that this thread has written and not deleted yet.
WRITTEN = Written()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and rereads it: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, *by: str) -> DataFrame:
    """Writes df, dealt by columns to so many partitions, as a bucketed table in the shared folder: groupings and joins by these columns need no exchange of it."""
    spark = df.sparkSession
    known = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{known}"
    WRITTEN.append(path)
    df.write.option("path", path).bucketBy(buckets, *by).saveAsTable(known)
    return spark.table(known)


def sweep(spark: SparkSession, since: int = 0, keep: str = "") -> None:
    """Deletes the tables that this thread has written, but for the first `since` and `keep`. Results that still read them must be used up before."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in [w for w in WRITTEN[since:] if w != keep]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        WRITTEN.remove(path)


def steady(df: DataFrame) -> bool:
    """Whether df is a projection of one file scan: such a frame gives each task the same rows in the same order each time."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() == "Project":
        node = node.children().head()
    return node.nodeName() == "LogicalRelation"


def keyed(docs: DataFrame, key: str = "key") -> DataFrame:
    """docs with its columns as c0, c1, ... and a number for each row, which stays the same however often the frame is read."""
    renamed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    if not steady(renamed):
        renamed = materialize(renamed, "rows")
    return renamed.withColumn(key, F.monotonically_increasing_id())


def scan_parts(spark: SparkSession, least: int = 12) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def id_ranks(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Adds out: the 0-based rank of each row within its keys, by order (nulls last). Equal rows are ranked in any order.

    Rows are dealt by ranges of (keys, order) and sorted there, so neither a hot key nor sparse ids crowd one task; a row's
    rank is its place in its range plus what earlier ranges have of its keys. That table has at most one row per key and
    one more per range.
    """
    by = [F.col(c).asc_nulls_last() for c in [*keys, *order]]
    dealt = df.repartitionByRange(scan_parts(df.sparkSession), *by).sortWithinPartitions(*by)
    dealt = materialize(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ranges")
    firsts = dealt.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_base")
    firsts = firsts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, "_part"])], base)
    same = F.lit(True)
    for i, c in enumerate([*keys, "_part"]):
        same = same & dealt[c].eqNullSafe(firsts[f"_k{i}"])
    return dealt.join(firsts, same).select(*df.columns, (F.col("_at") + F.col("_base")).alias(out))


def weights(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Characters of texts, elements of lists; 0 for null."""
    count = pc.list_value_length if pa.types.is_list(column.type) else pc.utf8_length
    return pc.fill_null(count(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def blocks(batches: Iterator[pa.RecordBatch], by: str, size: int, rows: int = BLOCK_ROWS) -> Iterator[tuple[int, pa.Table]]:
    """Cuts what a task reads into numbered blocks of about so many characters, whatever batches it comes in.

    A block depends on the order of a task's rows alone, so no content can crowd one.
    """
    held: list[pa.RecordBatch] = []
    total = count = number = 0
    base = TaskContext.get().partitionId() << 24
    for part in batches:
        each, start = weights(part.column(by)), 0
        while start < part.num_rows:
            ahead = np.cumsum(each[start:])
            stop = start + min(int(np.searchsorted(ahead, size - total)) + 1, rows - count, part.num_rows - start)
            held.append(part.slice(start, stop - start))
            total, count, start = total + int(ahead[stop - start - 1]), count + stop - start, stop
            if total >= size or count >= rows:
                yield base | number, pa.Table.from_batches(held)
                held, total, count, number = [], 0, 0, number + 1
    if held:
        yield base | number, pa.Table.from_batches(held)


def packed(rows: DataFrame, by: str, size: int) -> DataFrame:
    """block, rows: the blocks of a frame, each one compressed row. They are what an exchange moves instead of the texts."""
    schema = pa.schema([("block", pa.int64()), ("rows", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in blocks(batches, by, size):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as to:
                to.write_table(table)
            data = zstandard.ZstdCompressor(level=7).compress(memoryview(sink.getvalue()))
            yield tidy(batch(schema, block=[block], rows=[data]))

    return rows.mapInArrow(pack, "block long, rows binary")


def unpacked(table: pa.Table) -> pa.Table:
    """The rows of a block, from its one packed row."""
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(table.column("rows")[0].as_buffer())).read_all()


def tidy(out):
    """Passes out on and gives memory that a finished block used back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass
    return out


def blocks_for(df: DataFrame, text: str, chars: int, least: int = 12) -> int:
    """Blocks of about so many characters each."""
    total = df.agg(F.sum(F.length(text))).first()[0] or 0
    return max(least, -(-total // chars))


def batch(schema: pa.Schema, **columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}; the input has {', '.join(df.columns)}")
