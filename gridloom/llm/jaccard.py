"""Similarity join on sets of word shingles with prefix trees.

First, a document can only have a link if 85 % of its shingles occur in other documents too, so shingles are counted, in
packed form, by shards of their hashes; what falls short is set aside. Equal sets become one representative. Among those
left, shingles are put in one global order, rare ones first; linked sets share a shingle among their first few and lie in the same
or in neighbouring bands of length. So sets meet by leading shingle and band, around the most central of them (the hub): the hub goes to
every cell of its star, all others to one. A cell is joined with a trie of its ordered sets: a probe
descends it once, sets with a common beginning share the overlap counted so far, and a subtree is left as soon as what
remains of the probe or of its sets can't reach the threshold, or all its sets are connected to the probe already. Only where
a star takes several cells and these leave it in more than one component, the sets outside its largest component are joined with all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batch, blocks_for, materialize, packed, require, scan_parts, tidy, unpacked
from gridloom.llm.components import components

#: Characters of a block, shingles of a shard, shingles of one side of a cell.
BLOCK_CHARS, SHARD_SHINGLES, CELL = 4_000_000, 3_000_000, 1 << 18
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
MAIL = "block long, kind int, x binary, y binary"
MAIL_SCHEMA = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("x", pa.binary()), ("y", pa.binary())])
SHARD_SCHEMA = pa.schema([("shard", pa.int32()), *MAIL_SCHEMA])


class Words(dict):
    """word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


WORDS = Words()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * M2
    h = (h ^ (h >> np.uint64(29))) * M3
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of `width` words; with fewer words, of all of them as one."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=len(words))], dtype=np.uint64)
    n = len(h) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = mix(total * M1 + h[k : k + n])
    return np.unique(total)


def small(idx: np.ndarray) -> bytes:
    """Row numbers of a block in two bytes each where they fit; the first byte tells."""
    kind = "<u2" if not len(idx) or int(idx.max()) < 65536 else "<u4"
    return kind[-1:].encode() + idx.astype(kind).tobytes()


def large(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[:1].decode()}", offset=1).astype(np.int64)


def short(hashes: np.ndarray) -> bytes:
    """Three bytes of each hash. In a shard a few of them are equal by chance, which only counts more shingles as shared."""
    return np.ascontiguousarray((hashes >> np.uint64(32)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel()


def runs(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key with the places where it stands, in ascending order."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(keys[part[0]]), part


def count_messages(block: int, sets: list[np.ndarray], shards: int) -> pa.Table:
    """What a block tells the shards: hashes that one of its rows has (kind 0, with the row), those that several have
    (kind 1, once); and itself: each row's number of shingles, and of shingles that another of its rows has (kind 2)."""
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    same = np.zeros(len(flat), dtype=bool)
    if len(flat):
        equal = ordered[1:] == ordered[:-1]
        same[order[1:]] |= equal
        same[order[:-1]] |= equal
    rows: list[tuple] = []
    solo = np.flatnonzero(~same)
    for shard, at in runs((flat[solo] % np.uint64(shards)).astype(np.int32)):
        pick = solo[at]
        rows.append((shard, block, 0, short(flat[pick]), small(owner[pick])))
    several = np.unique(flat[same])
    for shard, at in runs((several % np.uint64(shards)).astype(np.int32)):
        rows.append((shard, block, 1, short(np.unique(several[at] >> np.uint64(32) & np.uint64(0xFFFFFF)) << np.uint64(32)), b""))
    own = np.bincount(owner[same], minlength=len(sets)).astype("<i4")
    rows.append((block % shards, block, 2, sizes.astype("<i4").tobytes(), own.tobytes()))
    return pa.Table.from_batches([batch(SHARD_SCHEMA, **dict(zip(SHARD_SCHEMA.names, zip(*rows), strict=True)))])


def count_shard(rows: pa.Table) -> pa.Table:
    """Tells each block how many of each row's hashes other blocks have too."""
    blocks, kinds = rows.column("block").to_pylist(), rows.column("kind").to_pylist()
    out: list[tuple] = []
    parts, owners, sources = [], [], []
    known = []
    for b, k, x, y in zip(blocks, kinds, rows.column("x"), rows.column("y"), strict=True):
        if k == 2:
            out.append((b, 2, x.as_py(), y.as_py()))
            continue
        fps = long(x.as_py())
        parts.append(fps)
        owners.append(large(y.as_py()) if k == 0 else np.full(len(fps), -1, np.int64))
        sources.append(np.full(len(fps), b, np.int64))
        known.append(np.full(len(fps), k == 1))
    if parts:
        fps, owner, source, known = map(np.concatenate, (parts, owners, sources, known))
        order = np.argsort(fps, kind="stable")
        start = np.r_[True, fps[order][1:] != fps[order][:-1]]
        group = np.cumsum(start) - 1
        hot = (np.bincount(group) > 1) | (np.bincount(group, weights=known[order]) > 0)
        pick = order[hot[group]]
        pick = pick[owner[pick] >= 0]
        for b, at in runs(source[pick]):
            idx, n = np.unique(owner[pick[at]], return_counts=True)
            out.append((b, 1, small(idx), n.astype("<i4").tobytes()))
    return pa.Table.from_batches([batch(MAIL_SCHEMA, **dict(zip(MAIL_SCHEMA.names, zip(*out) if out else [()] * 4, strict=True)))])


def shared(mail: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Each row's number of shingles, and of those that other rows have too."""
    sizes = counts = None
    later = []
    for k, x, y in zip(mail.column("kind").to_pylist(), mail.column("x").to_pylist(), mail.column("y").to_pylist(), strict=True):
        if k == 2:
            sizes, counts = np.frombuffer(x, "<i4").astype(np.int64), np.frombuffer(y, "<i4").astype(np.int64)
        elif k == 1:
            later.append((large(x), np.frombuffer(y, "<i4")))
    for idx, n in later:
        counts[idx] += n
    return sizes, counts


def peel(rows: DataFrame, payload: str, size: int, to_set, shards: int, percent: int, out: str, emit) -> DataFrame:
    """Counts each row's shingles that other rows have; emit makes the output of a block of rows.

    to_set(value of payload) gives a row's hashes; size: of a block, in characters or elements of payload.
    """

    def ask(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        values = unpacked(block).column(payload)
        return tidy(count_messages(key[0].as_py(), [to_set(x.as_py()) for x in values], shards))

    def answer(key: tuple[pa.Scalar, ...], block: pa.Table, mail: pa.Table) -> pa.Table:
        sizes, counts = shared(mail)
        return tidy(emit(unpacked(block), sizes, (sizes > 0) & (100 * counts >= percent * sizes)))

    dealt = packed(rows, payload, size)
    asked = dealt.groupBy("block").applyInArrow(ask, "shard int, " + MAIL)
    told = asked.groupBy("shard").applyInArrow(count_shard, MAIL)
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(answer, out)


class Trie:
    """Ordered sets that share what they begin with; nodes are runs of elements, as in a radix tree."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sizes = sizes
        self.runs: list[np.ndarray] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.kids: list[list[int]] = []
        self.ends: list[list[int]] = []
        self.least: list[int] = []
        self.longest: list[int] = []
        self.sets = sets
        self.root = self._grow(0, len(sets), 0)

    def _grow(self, lo: int, hi: int, depth: int) -> int:
        """The node of sets lo to hi, which agree in their first depth elements; built with a stack, children first."""
        todo = [(lo, hi, depth, -1)]
        order = []
        while todo:
            lo, hi, depth, parent = todo.pop()
            first, last = self.sets[lo], self.sets[hi - 1]
            n = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:n] != last[depth:n])
            end = depth + int(differ[0]) if len(differ) else n
            me = len(self.runs)
            self.runs.append(first[depth:end])
            self.low.append(lo)
            self.high.append(hi)
            self.kids.append([])
            self.least.append(int(self.sizes[lo:hi].min()))
            self.longest.append(max(len(s) for s in self.sets[lo:hi]) - end)
            at = lo
            while at < hi and len(self.sets[at]) == end:
                at += 1
            self.ends.append(list(range(lo, at)))
            if parent >= 0:
                self.kids[parent].append(me)
            order.append(me)
            while at < hi:
                stop = at + 1
                while stop < hi and self.sets[stop][end] == self.sets[at][end]:
                    stop += 1
                todo.append((at, stop, end, me))
                at = stop
        return order[0]

    def links(self, percent: int, label: np.ndarray) -> list[tuple[int, int]]:
        """Links that connect the sets as all links do, given labels of sets that are connected already."""
        found: list[tuple[int, int]] = []
        member = np.zeros(1 + max((int(s.max()) for s in self.sets if len(s)), default=0), dtype=bool)
        for x, mine in enumerate(self.sets):
            member[mine] = True
            size = int(self.sizes[x])
            stack = [(self.root, 0)]
            while stack:
                node, overlap = stack.pop()
                lo, hi = max(self.low[node], x + 1), self.high[node]
                if lo >= hi or (label[lo:hi] == label[x]).all():
                    continue
                run = self.runs[node]
                overlap += int(np.count_nonzero(member[run]))
                left = len(mine) - int(np.searchsorted(mine, run[-1], "right")) if len(run) else len(mine)
                reach = overlap + min(left, self.longest[node])
                if (100 + percent) * reach < percent * (size + max(self.least[node], 0)):
                    continue
                for y in self.ends[node]:
                    if y > x and label[y] != label[x] and (100 + percent) * overlap >= percent * (size + int(self.sizes[y])):
                        found.append((x, y))
                        label[label == label[y]] = label[x]
                stack.extend((kid, overlap) for kid in self.kids[node])
            member[mine] = False
        return found


def join_cell(rids: np.ndarray, sizes: np.ndarray, labels: np.ndarray, sets: list[tuple[np.ndarray, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """sets: (counts, hashes) of each; the common order has frequent shingles first, where near copies agree."""
    hashes = np.concatenate([s[1] for s in sets])
    counts = np.concatenate([s[0] for s in sets])
    names, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    place = np.empty(len(names), np.int64)
    place[np.lexsort((names, -counts[first]))] = np.arange(len(names))
    cuts = np.cumsum([len(s[1]) for s in sets])[:-1]
    local = [np.sort(p) for p in np.split(place[inverse], cuts)]
    order = sorted(range(len(local)), key=lambda i: local[i].astype(">u4").tobytes())
    trie = Trie([local[i] for i in order], sizes[order])
    return [(int(rids[order[a]]), int(rids[order[b]])) for a, b in trie.links(percent, np.unique(labels, return_inverse=True)[1][order])]


def links_of(cells: DataFrame, percent: int) -> DataFrame:
    """Joins every cell of cells(hub, i, j, rid, label, n, counts, hashes); rows of a cell stand together."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            rid, label, n = (np.array([h[k] for h in held]) for k in range(3))
            found = join_cell(rid, n, label, [h[3] for h in held], percent) if len(held) > 1 else []
            return batch(schema, a=[f[0] for f in found], b=[f[1] for f in found])

        for rows in batches:
            hub, i, j, rid, label, n = (rows.column(c).to_pylist() for c in range(6))
            counts, hashes = rows.column(6), rows.column(7)
            for r in range(rows.num_rows):
                if (hub[r], i[r], j[r]) != key:
                    if held:
                        yield done()
                    key, held = (hub[r], i[r], j[r]), []
                held.append((rid[r], label[r], n[r], (counts[r].values.to_numpy(), hashes[r].values.to_numpy())))
        if held:
            yield done()

    return cells.mapInArrow(run, "a long, b long")


def prefix(n: Column, percent: int) -> Column:
    """So many of the first elements of a set of n that linked sets share one of them."""
    return n - F.floor((n * percent + 99) / 100) + 1


def band(n: Column, percent: int) -> Column:
    """Linked sets lie in the same or in neighbouring bands; a band is a little wider than the threshold asks, whatever the rounding."""
    return F.floor(F.log(n.cast("double")) / max(1.001 * math.log(100 / percent), 1e-3)).cast("int")


def stars(ordered: DataFrame, percent: int) -> DataFrame:
    """hub, rid: every set with each hub that it meets, from ordered(rid, n, counts, hashes).

    Sets that can link share a leading shingle and one of two bands, so they meet the same hub: of all sets there the one whose
    shingles occur most often, as the text does that near copies were made from.
    """
    # Shingles that only one set has come first in the order and are left out; the rest of the prefix is what can be shared.
    lead = (prefix(F.col("n"), percent) - (F.col("n") - F.size("hashes"))).cast("int")
    central = F.aggregate("counts", F.lit(0.0), lambda x, y: x + y) / F.col("n")
    sets = ordered.filter(lead > 0).select("rid", F.struct(central.alias("c"), F.col("rid").alias("r")).alias("most"), band(F.col("n"), percent).alias("band"), F.slice("hashes", F.lit(1), lead).alias("lead"))
    leading = sets.select("rid", "most", F.explode("lead").alias("h"), "band").withColumn("b", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    hubs = leading.groupBy("h", "b").agg(F.max("most")["r"].alias("hub"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    return leading.select("rid", "h", "b").join(hubs, ["h", "b"]).filter("rid <> hub").select("hub", "rid").distinct()


def star_cells(star: DataFrame, weights: DataFrame, cell: int) -> tuple[DataFrame, DataFrame]:
    """hub, i, j, rid: each set in one cell of each of its stars, the hub in all of them; and hub, parts: the cells of each star."""
    sized = star.join(weights, "rid").groupBy("hub").agg(F.ceil(F.sum("w") / cell).cast("int").alias("parts"))
    placed = star.join(sized, "hub").select("hub", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int").alias("i"), F.lit(0).alias("j"), "rid")
    centre = sized.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.lit(0).alias("j"), F.col("hub").alias("rid"))
    return placed.unionByName(centre), sized


def cross_cells(star: DataFrame, labels: DataFrame, weights: DataFrame, cell: int) -> DataFrame:
    """hub, i, j, rid, label: what is left to join in stars whose cells left them in several components.

    star: hub, rid of such stars, hubs included; labels(rid, label), weights(rid, w, band). Sets are put into blocks by star, by whether
    they are in its largest component, and by band; two blocks meet if their bands are neighbours and one of them lies outside
    the largest component.
    """
    named = star.join(labels, "rid").join(weights, "rid")
    per = named.groupBy("hub", "label").agg(F.sum("w").alias("w"))
    most = per.groupBy("hub").agg(F.max(F.struct("w", "label"))["label"].alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    roles = named.join(most.select("hub", "top"), "hub").select("hub", "rid", "label", "w", "band", (F.col("label") == F.col("top")).alias("inside"))
    roles = materialize(roles, "roles")  # read four times below, each with all the joins above otherwise
    blocks = roles.groupBy("hub", "inside", "band").agg(F.ceil(F.sum("w") / cell).cast("int").alias("parts"))
    member = roles.join(blocks, ["hub", "inside", "band"]).select("hub", "rid", "label", F.struct("inside", "band", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int").alias("part")).alias("at"))
    each = blocks.select("hub", "inside", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("hub", F.struct("inside", "band", "part").alias("at"))
    a, b = each.select(F.col("hub").alias("h1"), F.col("at").alias("x")), each.select(F.col("hub").alias("h2"), F.col("at").alias("y"))
    meet = (F.col("h1") == F.col("h2")) & (F.abs(F.col("x.band") - F.col("y.band")) <= 1) & ~(F.col("x.inside") & F.col("y.inside")) & (F.col("x") <= F.col("y"))
    pairs = a.join(b, meet).select(F.col("h1").alias("hub"), F.xxhash64("x").alias("i"), F.xxhash64("y").alias("j"), F.explode(F.array_distinct(F.array("x", "y"))).alias("at"))
    return pairs.join(member, ["hub", "at"]).select("hub", "i", "j", "rid", "label")


def similarity_classes(docs: DataFrame, width: int = 4, percent: int = 85, block_chars: int = BLOCK_CHARS, shard_size: int = SHARD_SHINGLES, cell: int = CELL) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text).

    Words are runs of anything but ASCII white space, with A-Z lower-cased; a set is a text's distinct shingles of `width`
    words, or all its words as one if there are fewer. Rows link when the intersection is at least `percent` of
    the union; component_id is the smallest id that links reach. A null or empty text has an empty set and no link.
    Equal texts and repeated rows are linked through one representative. A null id never names a component unless all ids of one are
    null. An empty table gives no rows; other columns are ignored. All links between different sets are found, up to
    collisions of 64-bit hashes; they are kept as spanning trees, never as all pairs.
    """
    require(docs, "doc_id", "text")
    spark = docs.sparkSession
    least = 2 * scan_parts(spark)
    shards = max(scan_parts(spark), blocks_for(docs, "text", block_chars) * block_chars // 6 // shard_size)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def kept(table: pa.Table, sizes: np.ndarray, alive: np.ndarray) -> pa.Table:
        texts = table.column("text")
        sets = [shingles(texts[i].as_py(), width) if ok else None for i, ok in enumerate(alive.tolist())]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if s is not None else None for s in sets]
        half = lambda at: [int.from_bytes(k[at : at + 8], "little", signed=True) if k else None for k in keys]
        lists = pa.array([s.view(np.int64) if s is not None else None for s in sets], type=pa.list_(pa.int64()))
        return pa.table([table.column("doc_id"), pa.array(sizes), pa.array(half(0), pa.int64()), pa.array(half(8), pa.int64()), lists], schema=found)

    first = peel(rows, "text", block_chars, lambda t: shingles(t, width), shards, percent, "doc_id long, n long, k1 long, k2 long, hashes array<long>", kept)
    marked = materialize(first, "sets")
    sets = marked.filter("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("hashes").alias("hashes"))
    sets = materialize(sets.repartition(scan_parts(spark), "k1", "k2"), "classes").withColumn("rid", F.monotonically_increasing_id())
    again = pa.schema([("rid", pa.int64()), ("n", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def left(table: pa.Table, sizes: np.ndarray, alive: np.ndarray) -> pa.Table:
        return table.select(["rid", "n", "hashes"]).filter(pa.array(alive)).cast(again)

    to_set = lambda v: np.asarray(v, dtype=np.int64).view(np.uint64)
    live = materialize(peel(sets.select("rid", "n", "hashes"), "hashes", block_chars // 6, to_set, shards, percent, "rid long, n long, hashes array<long>", left), "live")
    each = live.select("rid", F.explode("hashes").alias("h"))
    often = each.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    ordered = each.join(often, "h").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("e"))
    ordered = materialize(ordered.join(live.select("rid", "n"), "rid").select("rid", "n", F.col("e.c").alias("counts"), F.col("e.h").alias("hashes")), "ordered")
    weights = ordered.select("rid", (F.size("hashes") + 16).alias("w"), band(F.col("n"), percent).alias("band"))
    star = materialize(stars(ordered, percent), "stars")
    cells, sized = star_cells(star, weights, cell)
    fields = ("hub", "i", "j", "rid", "label", "n", "counts", "hashes")

    def joined(cells: DataFrame) -> DataFrame:
        dealt = cells.join(ordered, "rid").select(*fields).repartition(least, "hub", "i", "j").sortWithinPartitions("hub", "i", "j", "rid")
        return materialize(links_of(dealt, percent), "found")

    links = joined(cells.withColumn("label", F.col("rid")))
    linked = components(links)
    wide = materialize(sized.filter("parts > 1"), "wide")
    if wide.take(1):
        spread = star.join(wide.select("hub"), "hub").unionByName(wide.select("hub", F.col("hub").alias("rid")))
        ends = spread.select("rid").distinct()
        labels = ends.join(linked, F.col("rid") == F.col("node"), "left").select("rid", F.coalesce("label", F.col("rid")).alias("label"))
        more = joined(cross_cells(spread, labels, weights, cell))
        if more.take(1):
            linked = components(links.union(more))
    named = sets.select("rid", "rep", "k1", "k2").join(linked, sets["rid"] == linked["node"], "left")
    named = named.select("rep", "k1", "k2", F.coalesce("label", F.col("rid")).alias("label"))
    lowest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    classes = named.join(lowest, "label").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "component_id")
    alone = marked.filter("k1 IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    some = marked.filter("k1 IS NOT NULL").select("doc_id", "n", "k1", "k2")
    some = some.join(classes, (some["k1"] == classes["c1"]) & (some["k2"] == classes["c2"]), "left")
    return alone.unionByName(some.select("doc_id", F.col("n").alias("n_shingles"), "component_id"))


CLASSES_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words
), each AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), often AS (
  SELECT g FROM each GROUP BY g HAVING count(*) > 1
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM (SELECT * FROM each SEMI JOIN often USING (g)) a JOIN (SELECT * FROM each SEMI JOIN often USING (g)) b
    ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.c AS component_id
FROM sets s JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON s.doc_id = r.x
"""
