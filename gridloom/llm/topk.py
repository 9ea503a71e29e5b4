"""Exact top-k search: tiled integer products of query and candidate blocks, partial selection, tree merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batch, materialize, require, scan_parts

QUERY_ROWS, ROWS = 512, 4096
#: Lists that one merge step takes in, and lists that a task holds at most.
FAN, HELD = 16, 1024
#: Tiles of one cell of the grid (a task's work), and bytes of queries that it holds at most.
TILES, QUERY_BYTES = 1 << 14, 1 << 26
BLOCK = "dims int, n int, ids binary, data binary"
LISTS = "qb long, list int, ids binary, top binary, scores binary"
LONG = np.iinfo(np.int64)


def sound(vector: Column) -> Column:
    """No null, no NaN, no infinity; a null vector isn't sound."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite, F.lit(False))


def blocks(vectors: DataFrame, rows_each: int) -> DataFrame:
    """Packs vectors(id, v) into blocks sorted by id; all vectors of a block have one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def pack(dims: int, part: list) -> pa.RecordBatch:
            ids = np.concatenate([p[0] for p in part])
            data = np.concatenate([p[1] for p in part])
            order = np.argsort(ids, kind="stable")
            small = np.abs(data).max(initial=0) < 2**15
            body = data[order].astype("<i2" if small else "<f8").tobytes()
            kind = pa.schema([("dims", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])
            return batch(kind, dims=[dims], n=[len(ids)], ids=[ids[order].astype("<i8").tobytes()], data=[body])

        for rows in batches:
            ids, lists = rows.column(0).to_numpy(), rows.column(1)
            sizes = np.asarray(lists.value_lengths())
            flat = np.floor(256.0 * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            starts = np.cumsum(sizes) - sizes
            for dims in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dims)
                for i in range(0, len(at), rows_each):
                    part = at[i : i + rows_each]
                    held.setdefault(dims, []).append((ids[part], flat[starts[part][:, None] + np.arange(dims)]))
                    if sum(len(p[0]) for p in held[dims]) + rows_each > 2 * rows_each or sum(len(p[0]) for p in held[dims]) >= rows_each:
                        yield pack(dims, held.pop(dims))
        for dims, part in held.items():
            yield pack(dims, part)

    return vectors.mapInArrow(run, BLOCK)


def matrix(row_n: int, dims: int, data: bytes) -> np.ndarray:
    kind = "<i2" if len(data) == 2 * row_n * dims else "<f8"
    return np.frombuffer(data, kind).reshape(row_n, dims).astype(np.float64)


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: in single or double precision where every partial sum fits, else in whole numbers of any size."""
    reach = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if reach < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    if reach < 2**53:
        return q @ c.T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(q) @ whole(c).T if q.size and c.size else np.zeros((len(q), len(c)), object), LONG.min + 1, LONG.max)


def select(scores: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each query's k best columns of a tile: ids and scores, best first, the least long as score where there are fewer.

    c_ids ascend, so a score and its column make one sortable number and ties fall to the smaller id; a query's own id
    is left out.
    """
    m, n = scores.shape
    low, high = np.searchsorted(c_ids, q_ids, "left"), np.searchsorted(c_ids, q_ids, "right")
    ids, best = np.full((m, k), -1, np.int64), np.full((m, k), LONG.min, np.int64)
    if scores.dtype == object or np.abs(scores).max(initial=0) * n >= 2**52:
        for i in range(m):
            order = [j for j in range(n) if not low[i] <= j < high[i]]
            order = sorted(order, key=lambda j, r=scores[i]: (-int(r[j]), j))[:k]
            ids[i, : len(order)], best[i, : len(order)] = c_ids[order], [int(scores[i, j]) for j in order]
        return ids, best
    key = scores * n + np.arange(n - 1, -1, -1, dtype=np.float64)
    for i in np.flatnonzero(high > low):
        key[i, low[i] : high[i]] = -np.inf
    kept = min(k, n)
    part = -np.sort(-np.partition(key, n - kept, axis=1)[:, n - kept :], axis=1)
    real = np.isfinite(part)
    score = np.floor_divide(np.where(real, part, 0), n)
    column = (n - 1 - (np.where(real, part, 0) - score * n)).astype(np.int64)
    ids[:, :kept] = np.where(real, c_ids[column], -1)
    best[:, :kept] = np.where(real, score, LONG.min).astype(np.int64)
    return ids, best


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The better half of two lists per query, by score, then by smaller id; places without a row come last."""
    ids, scores = np.concatenate([a[0], b[0]], 1), np.concatenate([a[1], b[1]], 1)
    none = scores == LONG.min
    wide = np.abs(scores[~none].astype(np.float64)).max(initial=0) >= 2**53
    down = np.array([[-int(x) for x in r] for r in scores], dtype=object) if wide else -scores.astype(np.float64)
    if wide:
        order = np.array([sorted(range(ids.shape[1]), key=lambda j, i=i: (none[i, j], down[i, j], ids[i, j])) for i in range(len(ids))])
    else:
        order = np.lexsort((ids, down, none), axis=1)
    order = order[:, : a[0].shape[1]]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def grid(nq: int, nc: int, q_bytes: float, c_bytes: float, cores: int) -> tuple[int, int]:
    """Groups of query blocks and of candidate blocks whose pairs are the cells.

    A query block is sent once for each group of candidates, a candidate block once for each group of queries. The groups are as large as
    a cell's tiles and the queries that a task can hold allow, and of such sizes that both sides cost as many bytes; with few tiles there are as many cells as cores.
    """
    side = max(1, round((TILES * q_bytes / c_bytes) ** 0.5)) if c_bytes else 1
    queries = max(1, min(TILES // min(side, TILES), int(QUERY_BYTES // max(1, q_bytes))))
    down = max(1, -(-nq // queries))
    return down, max(1, -(-nc // max(1, TILES // queries)), min(nc, -(-cores // down)))


def top_k(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k best rows by integer product.

    A component x counts as floor(256 x). Vectors that are null or hold a null, NaN or infinity take no part, nor do rows
    without an id; only vectors of one length meet. Rows with the query's own id are left out, ties go to the smaller id,
    repeated rows count each, a score beyond 64 bits is held at the limit. An empty table gives no rows, and other columns
    are ignored.

    Queries and candidates are packed into blocks. Both are dealt to a grid of cells, so that each pair of blocks meets in
    one task, one tile at a time; a task keeps the best k per query of all tiles that it has seen, and the lists of
    the tasks are merged as a tree, at most FAN at a time.
    """
    require(vectors, vec_id, vector)
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & sound(F.col("v")))
    q = blocks(rows.filter(F.col("id") % every == 0), QUERY_ROWS).withColumn("side", F.lit("q"))
    packed = materialize(q.unionByName(blocks(rows, ROWS).withColumn("side", F.lit("c"))), "vectors").withColumn("block", F.monotonically_increasing_id())
    bytes_of = F.max(F.length("ids") + F.length("data"))
    sizes = {r["side"]: (r["n"], r["size"]) for r in packed.groupBy("side").agg(F.count(F.lit(1)).alias("n"), bytes_of.alias("size")).collect()}
    (nq, q_bytes), (nc, c_bytes) = sizes.get("q", (0, 0)), sizes.get("c", (0, 0))
    down, over = grid(nq, nc, q_bytes, c_bytes, scan_parts(spark))
    put = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    queries = packed.filter("side = 'q'").select(
        F.col("block").alias("qb"), "dims", F.col("n").alias("m"), F.col("ids").alias("q_ids"), F.col("data").alias("q"), put(down).alias("down"), F.explode(F.sequence(F.lit(0), F.lit(over - 1))).alias("over")
    )
    candidates = packed.filter("side = 'c'").select("dims", "n", "ids", "data", put(over).alias("over"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("down"))
    tiles = queries.hint("shuffle_hash").join(candidates, ["down", "over", "dims"]).select("qb", "over", "dims", "m", "q_ids", "q", "n", "ids", "data")
    schema = pa.schema([("qb", pa.int64()), ("list", pa.int32()), ("ids", pa.binary()), ("top", pa.binary()), ("scores", pa.binary())])

    def out(held: dict) -> pa.RecordBatch:
        keys = list(held)
        return batch(schema, qb=[x[0] for x in keys], list=[x[1] for x in keys], ids=[held[x][0] for x in keys], top=[held[x][1][0].tobytes() for x in keys], scores=[held[x][1][1].tobytes() for x in keys])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[bytes, tuple[np.ndarray, np.ndarray]]] = {}
        for part in batches:
            for i in range(part.num_rows):
                r = {name: part.column(name)[i].as_py() for name in part.schema.names}
                q_ids, c_ids = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                scores = product(matrix(r["m"], r["dims"], r["q"]), matrix(r["n"], r["dims"], r["data"]))
                found, key = select(scores, q_ids, c_ids, k), (r["qb"], r["over"])
                held[key] = (r["q_ids"], merge(held[key][1], found) if key in held else found)
            if len(held) > HELD:
                yield out(held)
                held = {}
        yield out(held)

    def join(tables: pa.Table) -> pa.Table:
        best = None
        for top, scores in zip(tables.column("top").to_pylist(), tables.column("scores").to_pylist(), strict=True):
            pair = (np.frombuffer(top, "<i8").reshape(-1, k), np.frombuffer(scores, "<i8").reshape(-1, k))
            best = pair if best is None else merge(best, pair)
        first = tables.slice(0, 1)
        return pa.Table.from_batches([batch(schema, qb=first.column("qb").to_pylist(), list=first.column("list").to_pylist(), ids=first.column("ids").to_pylist(), top=[best[0].tobytes()], scores=[best[1].tobytes()])])

    lists, n = tiles.mapInArrow(multiply, LISTS), over
    while True:
        lists = lists.withColumn("list", (F.col("list") / FAN).cast("int")).groupBy("qb", "list").applyInArrow(join, LISTS)
        n = -(-n // FAN)
        if n <= 1:
            break
    result = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for ids, top, scores in zip(*(part.column(c).to_pylist() for c in ("ids", "top", "scores")), strict=True):
                ids, top, scores = np.frombuffer(ids, "<i8"), np.frombuffer(top, "<i8"), np.frombuffer(scores, "<i8")
                real = scores > LONG.min
                yield batch(result, query_id=np.repeat(ids, k)[real], rank=np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids))[real], vec_id=top[real], score=scores[real])

    return lists.mapInArrow(unpack, "query_id long, rank int, vec_id long, score long")


TOP_K_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
