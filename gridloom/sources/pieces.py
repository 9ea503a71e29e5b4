"""Image data in pieces: executors write and commit one .vti file per slab of planes, the driver writes the .pvti index alone."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.checkpoint import delete
from gridloom.sources.sinks import CHUNK, TEXT, encoded
from gridloom.spec import GridSpec

ORDER = ("piece", "part", "z", "chunk")


def slab(k: int | Column, planes: int, grid: GridSpec) -> tuple:
    """The planes from and to which a piece reaches, as numbers or columns."""
    return (k * planes, min(k * planes + planes, grid.nz)) if isinstance(k, int) else (k * planes, F.least(k * planes + planes, F.lit(grid.nz)))


def data_lines(field: DataFrame, grid: GridSpec, columns: Sequence[str], number: int, planes: int, outside: float) -> DataFrame:
    """piece, part, z, chunk, value: the text of some rows of a plane each; those without cells hold the outside value."""
    rows = max(1, CHUNK // grid.nx)
    chunks = -(-grid.ny // rows)
    at = F.col("id")
    every = field.sparkSession.range(grid.nz * chunks).select(F.floor(at / chunks).cast("int").alias("z"), (at % chunks).cast("int").alias("chunk"))
    made = encoded(field, grid, columns, TEXT, outside).select("z", "chunk", F.decode("data", "UTF-8").alias("text"))
    empty = " ".join([f"{outside:.17g}"] * len(columns)) + "\n"
    cells = F.least(F.lit(rows), F.lit(grid.ny) - F.col("chunk") * rows) * grid.nx
    joined = every.join(made, ["z", "chunk"], "left").withColumn("text", F.coalesce("text", F.repeat(F.lit(empty), cells.cast("int"))))
    return joined.select(F.floor(F.col("z") / planes).cast("int").alias("piece"), F.lit(3 * number + 2).alias("part"), "z", "chunk", F.rtrim("text", F.lit("\n")).alias("value"))


def lines(field: DataFrame, grid: GridSpec, fields: dict[str, Sequence[str]], planes: int, outside: float) -> DataFrame:
    """piece, part, z, chunk, value: all lines of all pieces."""
    spark = field.sparkSession
    n, last = -(-grid.nz // planes), 3 * len(fields) + 1
    low, high = slab(F.col("id").cast("int"), planes, grid)
    extent = lambda a, b: F.concat(F.lit(f"0 {grid.nx} 0 {grid.ny} "), a.cast("string"), F.lit(" "), b.cast("string"))
    whole = F.lit(f"0 {grid.nx} 0 {grid.ny} 0 {grid.nz}")
    head = F.concat(
        F.lit('<?xml version="1.0"?>\n<VTKFile type="ImageData" version="0.1" byte_order="LittleEndian">\n<ImageData WholeExtent="'), whole,
        F.lit(f'" Origin="{" ".join(f"{v:g}" for v in grid.origin)}" Spacing="{" ".join(f"{v:g}" for v in grid.spacing)}">\n<Piece Extent="'), extent(low, high), F.lit('">\n<CellData>'),
    )
    marks = [(0, head), (last, F.lit("</CellData>\n</Piece>\n</ImageData>\n</VTKFile>"))]
    for k, (name, columns) in enumerate(fields.items()):
        marks += [(3 * k + 1, F.lit(f'<DataArray type="Float64" Name="{name}" NumberOfComponents="{len(columns)}" format="ascii">')), (3 * k + 3, F.lit("</DataArray>"))]
    # The closing tag of a field and the opening one of the next don't share a number: 3 k + 3, then 3 k + 4.
    frame = spark.range(n).select(F.col("id").cast("int").alias("piece"), F.explode(F.array(*[F.struct(F.lit(p).alias("part"), v.alias("value")) for p, v in marks])).alias("m"))
    frame = frame.select("piece", F.when((F.col("m.part") == last) & F.col("m.value").startswith("</CellData>"), last + 1).otherwise(F.col("m.part")).cast("int").alias("part"), F.lit(0).alias("z"), F.lit(0).alias("chunk"), "m.value")
    return reduce(DataFrame.unionByName, [data_lines(field, grid, columns, k, planes, outside) for k, columns in enumerate(fields.values())], frame)


def write_pieces(folder: str, field: DataFrame, grid: GridSpec, fields: dict[str, Sequence[str]], planes: int = 64, outside: float = 0.0) -> int:
    """Writes image.pvti and piece-<k>.vti with values of cells into a folder of any file system that Spark knows; the number of pieces.

    fields: a name and the columns of its components. Each piece is one file that one task writes and Spark commits; nothing of it passes the driver, which renames
    files and writes the index. A piece of planes without cells holds the outside value. An existing image is replaced at the end.
    """
    spark, n = field.sparkSession, -(-grid.nz // planes)
    work = f"{folder.rstrip('/')}/_writing-{uuid.uuid4().hex}"
    rows = lines(field, grid, fields, planes, outside).repartition(max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions")))), "piece")
    rows.sortWithinPartitions(*ORDER).select("piece", "value").write.partitionBy("piece").text(work)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(work).getFileSystem(conf)
    names = []
    for k in range(n):
        found = [s.getPath() for s in fs.listStatus(path(f"{work}/piece={k}")) if s.getPath().getName().startswith("part-")]
        names.append(f"piece-{k}.vti")
        target = path(f"{folder}/{names[-1]}")
        fs.delete(target, False)
        fs.rename(found[0], target)
    out = fs.create(path(f"{folder}/image.pvti"), True)
    out.write(bytearray(index(grid, fields, planes, names).encode()))
    out.close()
    delete(spark, work)
    return n


def index(grid: GridSpec, fields: dict[str, Sequence[str]], planes: int, names: Sequence[str]) -> str:
    """The text of the .pvti file."""
    found = ['<?xml version="1.0"?>', '<VTKFile type="PImageData" version="0.1" byte_order="LittleEndian">']
    found.append(f'<PImageData WholeExtent="0 {grid.nx} 0 {grid.ny} 0 {grid.nz}" GhostLevel="0" Origin="{" ".join(f"{v:g}" for v in grid.origin)}" Spacing="{" ".join(f"{v:g}" for v in grid.spacing)}">')
    found += ["<PCellData>", *[f'<PDataArray type="Float64" Name="{name}" NumberOfComponents="{len(columns)}"/>' for name, columns in fields.items()], "</PCellData>"]
    for k, name in enumerate(names):
        low, high = slab(k, planes, grid)
        found.append(f'<Piece Extent="0 {grid.nx} 0 {grid.ny} {low} {high}" Source="{name}"/>')
    return "\n".join([*found, "</PImageData>", "</VTKFile>", ""])


def read_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """piece, content of each piece file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "piece-*.vti").load(folder)
    return files.select(F.regexp_extract("path", r"piece-(\d+)\.vti$", 1).cast("int").alias("piece"), "content")
