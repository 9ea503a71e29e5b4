"""Near duplicates among vectors: lattice hashing. Random projections are decoded to points of E8, in several tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batch, keyed, materialize, require, scan_parts
from gridloom.llm.components import components
from gridloom.llm.topk import sound

#: Tables, neighbouring cells that a vector looks into in each, and how long the eight projections of a unit vector are together.
TABLES, PROBES, SCALE, SEED = 10, 2, 2.12, 7
#: Rows of a cell that are compared at a time; fuller cells are cut into blocks, each pair of which is a group of its own.
BLOCK = 2048
#: Cosines so near to the threshold are computed anew, component by component.
CLOSE = 1e-9
UNIT = 1 << 20


@lru_cache(maxsize=1)
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled: two coordinates of 2, or eight of 1 with an even number of minus signs."""
    pairs = []
    for i, j in combinations(range(8), 2):
        for a, b in product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            pairs.append(v)
    halves = [v for v in product((1, -1), repeat=8) if np.prod(v) > 0]
    return np.array(pairs + halves, dtype=np.int64)


def nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest whole numbers with an even sum: where it is odd, the coordinate that was rounded furthest goes the other way."""
    near = np.rint(x)
    gap = x - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(gap[odd]).argmax(1)
    near[odd, worst] += np.where(gap[odd, worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row, doubled, so that it is whole: the better of D8 and D8 shifted by a half."""
    a, b = nearest_even(x), nearest_even(x - 0.5) + 0.5
    better = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.rint(2 * np.where(better[:, None], a, b)).astype(np.int64)


@lru_cache(maxsize=16)
def projections(dims: int, tables: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Eight directions per table, as whole numbers, and the tables' random shifts. Unit vectors have projections of length `scale`, in the mean of squares."""
    rng = np.random.default_rng([SEED, dims])
    drawn = rng.normal(size=(tables, max(8, dims), 8))
    basis = np.concatenate([np.linalg.qr(t)[0][:dims] for t in drawn], axis=1)
    return np.rint(basis * scale * np.sqrt(max(8, dims) / 8) * 4096), rng.uniform(0, 64, size=(tables, 1, 8))


def cells(units: np.ndarray, tables: int, probes: int, scale: float) -> np.ndarray:
    """[row, table, 1 + probes]: a number for the cell of each unit vector, and for the lattice points around it that are next nearest.

    Vectors and projections are taken as whole numbers, small enough for every partial sum to be exact, so a vector gets the same cells
    in whatever company it is computed.
    """
    n, dims = units.shape
    basis, shifts = projections(dims, tables, scale)
    flat = np.rint(units * UNIT) @ basis / (UNIT * 4096.0)
    out = np.empty((n, tables, 1 + probes), np.int64)
    around, powers = neighbours(), np.array([1_000_003**k % (2**61 - 1) for k in range(8)], dtype=np.int64)
    for t in range(tables):
        x = flat[:, 8 * t : 8 * t + 8] + shifts[t]
        point = decode(x)
        found = [point]
        if probes:
            toward = np.zeros((n, len(around)))
            for k in range(8):
                toward += (x - point / 2)[:, k, None] * around[:, k]
            order = np.argsort(-toward, axis=1, kind="stable")[:, :probes]
            found += [point + around[order[:, p]] for p in range(probes)]
        for p, f in enumerate(found):
            with np.errstate(over="ignore"):
                out[:, t, p] = (f * powers).sum(1) * np.int64(2654435761) + t
    return out


def unit_rows(flat: np.ndarray, dims: int) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    rows = flat.reshape(-1, dims).astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def linked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether each pair of rows has a cosine of at least `least`, in double precision."""
    cosine = a @ b.T
    out = cosine >= least
    for i, j in zip(*np.nonzero(np.abs(cosine - least) < CLOSE), strict=True):
        out[i, j] = float((a[i] * b[j]).sum()) >= least
    return out


def met_before(ci: np.ndarray, cj: np.ndarray, table: int, cell: int) -> np.ndarray:
    """Whether rows i and j, given their cells, meet elsewhere too, at a place that comes before this cell of this table.

    Places go by table; within one, the cell that i lies in comes first (and is the only one if j lies there too).
    """
    here_i = (cj[:, :, :] == ci[:, :, :1]).any(2)
    here_j = (ci[:, :, :] == cj[:, :, :1]).any(2)
    earlier = (here_i | here_j)[:, :table].any(1)
    return earlier | (here_i[:, table] & (ci[:, table, 0] != cell))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each node's component, over links a, b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        after = np.minimum(after, after[after])
        if (after == label).all():
            return label
        label = after


def links(reps: DataFrame, least: float, tables: int, probes: int, scale: float, block: int = BLOCK) -> DataFrame:
    """key, add, root: for each of reps(key, group, m, v) that has links found in a group of rows, what these add to its number, and a row linked to it.

    Which cells hold two rows is found out with keys alone; vectors then go to those. A cell with more than `block` rows is cut into
    blocks by key, and each pair of blocks meets in a group of its own. A pair counts where it meets first, so
    no pair is ever sent anywhere.
    """
    spark = reps.sparkSession
    slim = pa.schema([("key", pa.int64()), ("group", pa.string()), ("table", pa.int32()), ("cell", pa.int64()), ("home", pa.bool_())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sizes = np.asarray(rows.column("v").value_lengths())
            for dims in np.unique(sizes).tolist():
                part = rows.take(pa.array(np.flatnonzero(sizes == dims)))
                at = cells(unit_rows(part.column("v").flatten().to_numpy(zero_copy_only=False), dims), tables, probes, scale)
                n, each = len(at), tables * (1 + probes)
                index = pa.array(np.repeat(np.arange(n), each))
                yield batch(
                    slim,
                    key=part.column("key").take(index),
                    group=part.column("group").take(index),
                    table=np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 + probes), n),
                    cell=at.reshape(-1),
                    home=np.tile(np.arange(1 + probes) == 0, n * tables),
                )

    where = ["group", "table", "cell"]
    placed = materialize(reps.select("key", "group", "v").mapInArrow(place, "key long, group string, table int, cell long, home boolean"), "cells")
    full = placed.groupBy(*where).agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("lived")).filter("n > 1 AND lived")
    full = full.select(*where, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    mine = placed.join(full, where).select("key", "table", "cell", "home", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    mine = mine.select("key", "table", "cell", "home", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    by = ["group", "table", "cell", "i", "j"]
    near = mine.join(reps, "key").repartition(scan_parts(spark), *by).sortWithinPartitions(*by, "key").select(*by, "own", "home", "key", "m", "v")
    out = pa.schema([("key", pa.int64()), ("add", pa.int64()), ("root", pa.int64())])

    def compare(place: tuple[int, int, int, int], units: np.ndarray, keys: np.ndarray, m: np.ndarray, home: np.ndarray, own: np.ndarray) -> pa.RecordBatch | None:
        """The rows of one group, at (table, cell, i, j)."""
        table, cell, i, j = place
        a, b = (slice(None),) * 2 if i == j else (np.flatnonzero(own == i), np.flatnonzero(own == j))
        hit = linked(units[a], units[b], least)
        if np.count_nonzero(hit) <= (len(keys) if i == j else 0):
            return None
        hit &= (home[a][:, None] | home[b]) & (keys[a][:, None] < keys[b] if i == j else True)
        p, q = np.nonzero(hit)
        if not len(p):
            return None
        p, q = np.arange(len(keys))[a][p], np.arange(len(keys))[b][q]
        swap = keys[p] > keys[q]
        p, q = np.where(swap, q, p), np.where(swap, p, q)
        used, at = np.unique(np.concatenate([p, q]), return_inverse=True)
        p, q = at[: len(p)], at[len(p) :]
        spots, weight, add = cells(units[used], tables, probes, scale), m[used], np.zeros(len(used), np.int64)
        for s in range(0, len(p), 65536):
            x, y = p[s : s + 65536], q[s : s + 65536]
            first = ~met_before(spots[x], spots[y], table, cell)
            np.add.at(add, x[first], weight[y[first]])
            np.add.at(add, y[first], weight[x[first]])
        return batch(out, key=keys[used], add=add, root=keys[used][roots(len(used), p, q)])

    def groups(rows: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
        """What the whole groups of sorted rows give, and the rows of the group that may go on, unless these are the last."""
        columns = {c: rows.column(c).combine_chunks() for c in rows.column_names}
        plain = {c: columns[c].to_numpy(zero_copy_only=False) for c in ("table", "cell", "i", "j", "own", "home", "key", "m")}
        new = np.ones(rows.num_rows, bool)
        group = columns["group"].dictionary_encode().indices.to_numpy()
        new[1:] = group[1:] != group[:-1]
        for c in by[1:]:
            new[1:] |= plain[c][1:] != plain[c][:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], rows.num_rows)
        if not last:
            starts, ends = starts[:-1], ends[:-1]
        kept, flat = rows.slice(int(ends[-1]) if len(ends) else 0), columns["v"].flatten().to_numpy(zero_copy_only=False)
        sizes = np.asarray(columns["v"].value_lengths())
        at = np.cumsum(np.append(0, sizes))
        several = [(s, e) for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if e - s > 1]
        units = unit_rows(flat, int(sizes[0])) if len(sizes) and (sizes == sizes[0]).all() else None
        made = []
        for s, e in several:
            own_units = units[s:e] if units is not None else unit_rows(flat[at[s] : at[e]], int(sizes[s]))
            place = tuple(int(plain[c][s]) for c in ("table", "cell", "i", "j"))
            made.append(compare(place, own_units, *(plain[c][s:e] for c in ("key", "m", "home", "own"))))
        return [x for x in made if x is not None], kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for rows in batches:
            rows = pa.Table.from_batches([rows])
            made, held = groups(rows if held is None else pa.concat_tables([held, rows]), False)
            yield from made
        if held is not None:
            yield from groups(held, True)[0]

    return near.mapInArrow(run, "key long, add long, root long")


def near_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str | None = "label",
    least: float = 0.93,
    tables: int = TABLES,
    probes: int = PROBES,
    scale: float = SCALE,
    block: int = BLOCK,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors: how many others are linked with it, the smallest id that it reaches, and whether that is its own.

    Two vectors are compared if they have equal labels (where `label` is given), as many components, and cells of E8 in common in one table at least: one
    lies in a cell in which the other lies, or into which it looks. Those with a cosine of at least `least` are linked, none other. With the
    settings given, a pair at a cosine of 0.93 is found with a probability of 0.99, closer ones nearly always; every vector is
    indexed, and no cell is capped. Tables of billions of vectors want a larger scale, and more tables for the same recall.

    A vector that is null, empty, zero or holds a null, NaN or infinity, a row without a label or without an id has no links, and is its own
    component (null without an id; kept is then null). Repeated rows are linked with each other, each counts; equal vectors are
    compared once, with their number. An empty table gives no rows; other columns are ignored.
    """
    require(vectors, vec_id, vector, *([label] if label else []))
    cols = [F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), (F.col(label).cast("string") if label else F.lit("")).alias("group")]
    # Only vectors of one label and one length meet.
    rows = keyed(vectors.select(*cols), "row").toDF("id", "v", "group", "row").withColumn("group", F.concat(F.size("v").cast("string"), F.lit(" "), "group"))
    part = F.col("id").isNotNull() & F.col("group").isNotNull() & sound(F.col("v")) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    # Equal vectors are told by 128 bits of hash.
    hashes = [F.xxhash64(F.lit(k), F.col("v")).alias(f"h{k}") for k in (0, 1)]
    live = rows.filter(part).select("id", "group", "v", *hashes)
    same = ["group", "h0", "h1"]
    reps = live.groupBy(*same).agg(F.min("id").alias("key"), F.count(F.lit(1)).alias("m"), F.any_value("v").alias("v"))
    # Vectors with equal ids keep numbers of their own until components are formed.
    reps = materialize(reps.select(*same, F.col("key").alias("id"), F.monotonically_increasing_id().alias("key"), "m", "v"), "reps")
    found = materialize(links(reps.select("key", "group", "m", "v"), least, tables, probes, scale, block), "found")
    added = found.groupBy("key").agg(F.sum("add").alias("add"))
    label_of = components(found.filter("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")))
    least_id = label_of.join(reps.select(F.col("key").alias("node"), "id"), "node").groupBy("label").agg(F.min("id").alias("least"))
    reached = label_of.join(least_id, "label").select(F.col("node").alias("key"), "least")
    ends = reps.join(added, "key", "left").join(reached, "key", "left")
    ends = ends.select(*same, (F.coalesce("add", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("least", "id").alias("reached"))
    own = rows.select("id", "group", *[F.when(part, h).alias(f"h{k}") for k, h in enumerate(hashes)])
    joined = own.join(ends, same, "left")
    return joined.select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("reached", "id").alias("component_id"),
        (F.coalesce("reached", "id") == F.col("id")).alias("kept"),
    )


NEAR_VECTORS_SQL = """
WITH r AS (SELECT row_number() OVER () AS k, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS MATERIALIZED (SELECT k, vec_id, label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM r
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.k AS a, b.k AS b, b.vec_id AS id FROM s a JOIN s b ON a.label = b.label AND len(a.v) = len(b.v) AND a.k <> b.k WHERE list_inner_product(a.v, b.v) >= 0.93),
n AS (SELECT a AS k, count(*) AS n FROM p GROUP BY a),
c AS (WITH RECURSIVE t(k, id) AS (SELECT k, vec_id FROM s UNION SELECT p.b, t.id FROM t JOIN p ON p.a = t.k) SELECT k, min(id) AS id FROM t GROUP BY k)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c.id, vec_id) AS component_id, coalesce(c.id, vec_id) = vec_id AS kept FROM r LEFT JOIN n USING (k) LEFT JOIN c USING (k)
"""
