"""Packed block tables against columns and NumPy, and what they shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.lbm import uniform
from gridloom.lbm.lattice import Cavity
from gridloom.operators import packed, stencils
from gridloom.plans import checkpoint
from gridloom.sources import cells as source
from gridloom.spec import COORDS, S6, S27, GridSpec, Stencil


def hollow(spark):
    return source.sparse(spark, GridSpec(19, 7, 21), source.geometry("hollow_cube", (19, 7, 21), 1.0, 0.3)).withColumn("v", source.seeded(1, 99)).select(*[(F.col(c) - 5).alias(c) for c in COORDS], "v")


def same(a, b):
    columns = sorted(a.columns)
    return sorted(map(tuple, a.select(columns).collect()), key=repr) == sorted(map(tuple, b.select(columns).collect()), key=repr)


@pytest.mark.parametrize("size", [4, 8])
def test_round_trip(spark, size):
    cells = hollow(spark).withColumn("f", F.array(F.col("v") * 1.5, F.lit(2.0))).withColumn("k", F.when(F.col("v") > 5, F.col("v").cast("int")))
    table = packed.pack(cells, ["v", "f", "k"], size, {"f": 2})
    assert same(packed.unpack(table), cells.withColumn("k", F.coalesce("k", F.lit(0))))
    assert same(packed.unpack(table, ["f"]), cells.select(*COORDS, "f"))
    total = table.frame().agg(F.sum(packed.count_bits("active"))).first()[0]
    assert total == cells.count()
    table.drop()
    assert table.table not in checkpoint.PLACES and not spark.catalog.tableExists(table.table)


def test_wrong_input(spark):
    cells = hollow(spark)
    with pytest.raises(Exception, match="two cells have one place"):
        packed.pack(cells.unionAll(cells.limit(1)), ["v"])
    with pytest.raises(ValueError, match="how many components"):
        packed.pack(cells.withColumn("f", F.array("v")), ["f"])
    with pytest.raises(ValueError, match="no packed form"):
        packed.pack(cells.withColumn("s", F.lit("x")), ["s"])
    with pytest.raises(Exception, match="components in every cell"):
        packed.pack(cells.withColumn("f", F.array("v")), ["f"], components={"f": 2})
    empty = packed.pack(cells.limit(0), ["v"])
    assert packed.unpack(packed.step(empty, packed.laplace_count("v"), empty.fields, ["v"])).count() == 0
    far = Stencil(((9, 0, 0),))
    with pytest.raises(ValueError, match="beyond the next block"):
        packed.step(empty, packed.laplace_count("v"), empty.fields, ["v"], far)


@pytest.mark.parametrize("size", [4, 8])
def test_stencils_equal_columns(spark, size):
    cells = hollow(spark)
    table = packed.pack(cells, ["v"], size)
    twice = packed.iterate(table, 2, packed.laplace_count("v"), table.fields, ["v"])
    once = stencils.laplace_count(cells, "v").withColumnRenamed("value", "v")
    assert same(packed.unpack(twice), stencils.laplace_count(once, "v").withColumnRenamed("value", "v"))
    # Corners, and further than one cell.
    wide = Stencil(tuple((2 * a, b, 2 * c) for a, b, c in S27 if (a, b, c) != (0, 0, 0)))

    def kernel(h):
        total, count = packed.sums(h, "v", wide)
        return {"t": total, "c": count}

    made = packed.step(table, kernel, [packed.Field("t", "bigint"), packed.Field("c", "bigint")], ["v"], wide, keep=["v"])
    want = stencils.fold(cells, wide, "v").select(*COORDS, "v", F.coalesce("total", F.lit(0)).alias("t"), F.col("neighbours").alias("c"))
    assert same(packed.unpack(made), want)


def test_flow_equals_columns(spark):
    c = Cavity(11)
    cells = uniform.cavity(spark, c)
    out = packed.unpack(uniform.run_packed(uniform.pack(cells, 4), c.omega, 3))
    want = uniform.run(cells, c.omega, 3)
    got = {(r.x, r.y, r.z): (r.kind, r.wall, r.f) for r in out.collect()}
    rows = want.collect()
    assert len(rows) == len(got) == 11**3
    for r in rows:
        kind, wall, f = got[r.x, r.y, r.z]
        assert (kind, wall) == (r.kind, r.wall) and np.allclose(f, r.f, atol=1e-13)


def shuffled(spark):
    """Bytes that the stages of this application have written to shuffles."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_a_step_moves_faces_only(spark):
    """16^3 blocks of random values: a step may shuffle the six faces of 16^2 values per block of 16^3, not the blocks."""
    cells = source.dense(spark, GridSpec(64, 64, 32)).withColumn("v", F.xxhash64(*COORDS))
    table = packed.pack(cells, ["v"], 16)
    plan = packed.joined(table, ["v"], S6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert plan.index("Exchange hashpartitioning") > plan.index("SortMergeJoin")
    before = shuffled(spark)
    after = packed.step(table, packed.laplace_count("v"), table.fields, ["v"])
    moved = shuffled(spark) - before
    values = 64 * 64 * 32 * 8
    assert 0 < moved < 6 / 16 * values * 1.2
    assert packed.unpack(after).count() == 64 * 64 * 32


def test_checkpoints_are_deleted_and_need_a_shared_folder(spark):
    first = checkpoint.cut(spark.range(5), "a")
    second = checkpoint.cut(first.selectExpr("id + 1 AS id"), "b", first)
    assert sorted(r.id for r in second.collect()) == [1, 2, 3, 4, 5]
    with pytest.raises(Exception, match="(?i)not exist|FILE_NOT_EXIST|not found"):
        spark.read.parquet(first.inputFiles()[0]).count()

    class Elsewhere:
        master = "yarn"

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Elsewhere
        conf = {}

    class Frame:
        sparkSession = Session

    with pytest.raises(ValueError, match="share"):
        checkpoint.shared_folder(Frame)


def test_blocks_are_unpacked_by_planes(spark):
    """A batch that Python takes in holds planes, so a block of many components needs an eighth of the memory."""
    cells = spark.range(500).selectExpr("int(id % 10) AS x", "int(id DIV 10 % 10 - 3) AS y", "int(id DIV 100) AS z", "id AS v").filter("v % 7 <> 0").withColumn("f", F.array(F.col("v") * 1.0, F.col("v") * 2.0))
    table = packed.pack(cells, ["v", "f"], 8, {"f": 2})
    made = packed.unpack(table)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, cells.collect()))
    assert "slice(" in made._jdf.queryExecution().optimizedPlan().toString()
