"""Cutting the lineage of iterations with tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Places of the bucketed tables that aren't dropped yet.
PLACES: dict[str, str] = {}


def shared_folder(df: DataFrame | SparkSession) -> str:
    """spark.checkpoint.dir, or, in local mode alone, a temporary folder of this session where it is unset."""
    spark = df if isinstance(df, SparkSession) else df.sparkSession
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("gridloom.grid.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        spark.conf.set("gridloom.grid.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame, name: str = "state", *gone: DataFrame) -> DataFrame:
    """Writes df and reads it back: what follows doesn't depend on how it was made, nor on any executor's memory.

    gone: frames that cut gave back and that nothing needs any more once df is written; their files are deleted.
    """
    spark = df.sparkSession
    path = f"{shared_folder(df)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for old in gone:
        for file in {f.rsplit("/", 1)[0] for f in old.inputFiles()}:
            delete(spark, file)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session that holds inside only."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def bucketed(df: DataFrame, name: str, buckets: int, *by: str) -> str:
    """Writes df, which must be dealt by these columns into so many partitions, as a bucketed table in the shared folder; its name.

    What groups or joins such a table by these columns needs no exchange of it.
    """
    spark = df.sparkSession
    known = f"{name}_{uuid.uuid4().hex}"
    PLACES[known] = f"{shared_folder(df)}/{known}"
    df.write.option("path", PLACES[known]).bucketBy(buckets, *by).saveAsTable(known)
    return known


def discard(spark: SparkSession, table: str) -> None:
    """Drops a bucketed table and its files."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    if path := PLACES.pop(table, None):
        delete(spark, path)
