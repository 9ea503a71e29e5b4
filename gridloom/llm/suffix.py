"""Removal of repeated passages with sharded suffix arrays.

Any string of 50 bytes has an anchor: the first of its grams with the smallest hash, at the same place wherever the
string occurs. Strings whose anchor only one document has can't be repeated. Shards of the anchors'
hashes tell every block of documents which of its anchors other documents have too; for those, the block sends the
bytes that hold their strings, each distinct piece once, to the anchor's shard. So a start goes to one shard, once. The shard sorts the suffixes of all
its strings by external induction, finds runs of suffixes that share 50 bytes with the common-prefix lengths, takes the
smallest document of each run, and answers with the starts that an earlier document has.

An anchor with very many places would crowd its shard. The starts around such an anchor are sent in groups of a few
instead, each group to the shard of the bytes that all its strings have in common.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

from gridloom.llm.common import batch, blocks_for, packed, require, scan_parts, tidy, unpacked
from gridloom.llm.induced import IN_MEMORY, suffix_array

GRAM = 20
BLOCK_CHARS, SHARD_CHARS = 4_000_000, 2_000_000
LAST = 2**63 - 1
MAIL = "block long, kind int, rid long, x binary, y binary"
MAIL_SCHEMA = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("rid", pa.int64()), ("x", pa.binary()), ("y", pa.binary())])
ASK = "shard int, block long, kind int, x binary, y binary"
ASK_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("x", pa.binary()), ("y", pa.binary())])
SEND = "shard int, block long, kind int, x binary, y binary, ords binary, texts binary"
SEND_SCHEMA = pa.schema([*ASK_SCHEMA, ("ords", pa.binary()), ("texts", pa.binary())])
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Kinds of mail: copies (rid, the row in its block), anchors that others have too (row, place), starts to remove (row, place, bits),
#: anchors with many places (rid, their shard, and the hashes).
COPY, HOT, REMOVE, CROWDED = 0, 1, 2, 3
#: Places from which on an anchor's starts are split, and starts of a group then.
CROWD, GROUP = 4096, 8
#: Tasks that share one group of copies.
SALTS = 16
RESULTS = ("n_bytes", "n_removed", "n_spans", "kept")
PLACE = np.dtype([("row", "<u4"), ("at", "<u4")])
#: An anchor in a block: its strings start from `back` bytes before it on, at `more` places besides.
ANCHOR = np.dtype([("row", "<u2"), ("back", "u1"), ("more", "u1"), ("at", "<u4")])


def words_at(data: bytes) -> np.ndarray:
    """The eight bytes from each place on, as a number."""
    return np.ndarray(len(data), "<u8", data + bytes(8), strides=(1,)).copy()


def slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each window of `width` values."""
    out, n = values, 1
    while 2 * n <= width:
        out, n = pick(out[:-n], out[n:]), 2 * n
    if n < width:
        more = width - n
        out = pick(out[:-more], out[more:])
    return out


def gram_hashes(data: bytes) -> np.ndarray:
    w = words_at(data)
    m = len(data) - GRAM + 1
    h = w[:m] * M1
    h ^= h >> np.uint64(29)
    h += w[8 : 8 + m] * M2
    h ^= h >> np.uint64(31)
    h *= M3
    h ^= (w[GRAM - 8 : GRAM - 8 + m] * M1) >> np.uint64(17)
    h *= M2
    return h ^ (h >> np.uint64(32))


def anchors(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are the first smallest one in some string of `width` bytes; the first and last start of these strings."""
    if len(data) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = gram_hashes(data)
    n = width - GRAM + 1
    least = slide(h, n, np.minimum)
    # The next start has another anchor if this one's lies at its start, or if a smaller gram comes in.
    falls = least[1:] < least[:-1]
    first = np.concatenate([[0], np.flatnonzero(falls | (h[: len(least) - 1] == least[:-1])) + 1])
    value = least[first]
    at = first + n - 1
    look = np.flatnonzero(np.append(True, ~falls[first[1:] - 1]))
    seen = np.ndarray((len(least), n), h.dtype, h, strides=(8, 8))[first[look]]
    at[look] = first[look] + np.argmax(seen == value[look][:, None], axis=1)
    return at, value, first, np.append(first[1:], len(least)) - 1


def runs(keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    return [(int(keys[p[0]]), p) for p in np.split(order, cuts) if len(p)]


def to_table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([batch(schema, **dict(zip(schema.names, zip(*rows) if rows else [()] * len(schema), strict=True)))])


def places(row: np.ndarray, at: np.ndarray) -> bytes:
    out = np.empty(len(row), PLACE)
    out["row"], out["at"] = row, at
    return out.tobytes()


def spans(row: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> bytes:
    out = np.empty(len(row), ANCHOR)
    out["row"], out["at"], out["back"], out["more"] = row, at, at - low, high - low
    return out.tobytes()


def first_of_copies(n: int, mail: pa.Table) -> np.ndarray:
    own = np.ones(n, dtype=bool)
    own[[r for r, k in zip(mail.column("rid").to_pylist(), mail.column("kind").to_pylist(), strict=True) if k == COPY]] = False
    return own


def ask_anchors(block: int, texts: list[str], own: np.ndarray, ords: np.ndarray, shards: int, width: int) -> pa.Table:
    """Anchors of a block for the shards: those of one document (kind 0, with places), those of several (kind 1, once, with
    the number of their places; these go back to the block itself, kind 2, by way of any shard)."""
    found = []
    for i in np.flatnonzero(own).tolist():
        at, *more = anchors((texts[i] or "").encode("utf-8", "replace"), width)
        found.append((np.full(len(at), i, np.int64), at, *more))
    if not found:
        return to_table(ASK_SCHEMA, [])
    row, at, h, low, high = map(np.concatenate, zip(*found, strict=True))
    order = np.argsort(h, kind="stable")
    start = np.r_[True, h[order][1:] != h[order][:-1]] if len(h) else np.empty(0, bool)
    group = np.cumsum(start) - 1
    first = ords[row[order]][start]
    several = np.bincount(group[ords[row[order]] != first[group]], minlength=int(start.sum())) > 0
    many = np.zeros(len(h), bool)
    many[order] = several[group] if len(h) else []
    out: list[tuple] = []
    solo = np.flatnonzero(~many)
    for shard, pick in runs((h[solo] % np.uint64(shards)).astype(np.int32)):
        pick = solo[pick]
        out.append((shard, block, 0, (h[pick] >> np.uint64(32)).astype("<u4").tobytes(), spans(row[pick], at[pick], low[pick], high[pick])))
    once, each = np.unique(h[many], return_counts=True)
    for shard, pick in runs((once % np.uint64(shards)).astype(np.int32)):
        out.append((shard, block, 1, (once[pick] >> np.uint64(32)).astype("<u4").tobytes(), each[pick].astype("<u4").tobytes()))
    if many.any():
        out.append((block % shards, block, 2, spans(row[many], at[many], low[many], high[many]), b""))
    return to_table(ASK_SCHEMA, out)


def answer_anchors(rows: pa.Table, crowd: int = CROWD) -> pa.Table:
    """Tells each block the places of anchors that other blocks have too, and which anchors have `crowd` places or more."""
    out, parts, places_, sources, known, counts = [], [], [], [], [], []
    columns = (rows.column(c) for c in ("block", "kind", "x", "y"))
    for b, k, x, y in zip(*columns, strict=True):
        b, k = b.as_py(), k.as_py()
        if k == 2:
            out.append((b, HOT, 0, x.as_py(), b""))
            continue
        parts.append(np.frombuffer(x.as_py(), "<u4"))
        places_.append(np.frombuffer(y.as_py(), ANCHOR) if k == 0 else np.zeros(len(parts[-1]), ANCHOR))
        sources.append(np.full(len(parts[-1]), b, np.int64))
        known.append(np.full(len(parts[-1]), k == 1))
        counts.append(np.frombuffer(y.as_py(), "<u4") if k == 1 else np.ones(len(parts[-1]), "<u4"))
    if parts:
        fps, place, source, known, counts = map(np.concatenate, (parts, places_, sources, known, counts))
        order = np.argsort(fps, kind="stable")
        group = np.cumsum(np.r_[True, fps[order][1:] != fps[order][:-1]]) - 1
        n = int(group[-1]) + 1
        low, high = np.full(n, 2**62), np.full(n, -1)
        np.minimum.at(low, group, source[order])
        np.maximum.at(high, group, source[order])
        hot = (low < high) | (np.bincount(group, weights=known[order], minlength=n) > 0)
        pick = order[hot[group]]
        pick = pick[~known[pick]]
        for b, p in runs(source[pick]):
            out.append((b, HOT, 0, place[pick[p]].tobytes(), b""))
        shard = rows.column("shard")[0].as_py()
        pick = order[(np.bincount(group, weights=counts[order], minlength=n) >= crowd)[group]]
        for b, p in runs(source[pick]):
            out.append((b, CROWDED, shard, np.unique(fps[pick[p]]).tobytes(), b""))
    return to_table(MAIL_SCHEMA, out)


def crowded_anchors(mail: pa.Table) -> np.ndarray:
    """Shard and hash, in one number, of the anchors that a block was told to split. Every block that has one is told so."""
    rows = zip(*(mail.column(c).to_pylist() for c in ("kind", "rid", "x")), strict=True)
    found = [np.uint64(shard << 32) | np.frombuffer(x, "<u4").astype(np.uint64) for k, shard, x in rows if k == CROWDED]
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def split_starts(data: bytes, at: int, shards: int, width: int, low: int = 0, high: int | None = None):
    """Shard, start and stop of the strings of each group of starts around an anchor, from low to high at most.

    A group's shard is that of the bytes which all its strings of `width` bytes hold, so a string goes to one shard from wherever it stands.
    """
    for first in range(at + GRAM - width, at + 1, GROUP):
        last = min(first + GROUP - 1, at)
        start, stop = max(low, first), min(len(data), (last if high is None else min(last, high)) + width)
        if stop - start >= width:
            yield xxhash.xxh3_64_intdigest(data[last : first + width]) % shards, start, stop


def send_strings(block: int, texts: list[str], ords: np.ndarray, mail: pa.Table, shards: int, width: int) -> pa.Table:
    """The strings of hot anchors, by shard: each distinct string once, with its smallest document's order and places.

    Other places of a string in the block are settled: a smaller document of the block has it.
    """
    hot = [np.frombuffer(x, ANCHOR) for x, k in zip(mail.column("x").to_pylist(), mail.column("kind").to_pylist(), strict=True) if k == HOT]
    hot = np.concatenate(hot) if hot else np.empty(0, ANCHOR)
    hot = hot[np.argsort(hot["row"].astype(np.int64) << 32 | hot["at"])]
    at = hot["at"].astype(np.int64)
    low = at - hot["back"]
    stop = low + hot["more"] + width
    rows = [(i, (texts[i] or "").encode("utf-8", "replace"), p) for i, p in runs(hot["row"].astype(np.int64))]
    grams = [np.frombuffer(data, np.uint8)[at[p][:, None] + np.arange(GRAM)] for _, data, p in rows]
    hashes = gram_hashes_of(np.concatenate(grams)) if grams else np.empty(0, np.uint64)
    where = hashes % np.uint64(shards)
    split = np.isin(where << np.uint64(32) | hashes >> np.uint64(32), crowded_anchors(mail))
    # Only the shards that this block has strings for; the corpus has many more.
    by_shard: defaultdict[int, dict[bytes, list]] = defaultdict(dict)
    for i, data, p in rows:
        order = int(ords[i])
        for a, first, end, s, many in zip(*(c[p].tolist() for c in (at, low, stop, where, split)), strict=True):
            for s, start, end in split_starts(data, a, shards, width, first, end - width) if many else [(s, first, end)]:
                by_shard[s].setdefault(data[start:end], []).append((order, i, start))
    out, done_row, done_at, done_bits = [], [], [], []
    for s, strings in sorted(by_shard.items()):
        least, keep = [], []
        for text, seen in strings.items():
            low = min(seen)[0]
            least.append(low)
            mine = [(i, start) for o, i, start in seen if o == low]
            keep.append(mine)
            for o, i, start in seen:
                if o != low:
                    done_row.append(i)
                    done_at.append(start)
                    done_bits.append((1 << (len(text) - width + 1)) - 1)
        counts = np.fromiter(map(len, keep), dtype="<u4", count=len(keep))
        flat = [p for mine in keep for p in mine]
        lengths = np.fromiter(map(len, strings), dtype="<u4", count=len(strings))
        refs = places(np.array([p[0] for p in flat]), np.array([p[1] for p in flat]))
        out.append((s, block, 0, lengths.tobytes() + counts.tobytes(), refs, np.array(least, "<i8").tobytes(), b"".join(strings)))
    if done_row:
        out.append((block % shards, block, 2, places(np.array(done_row), np.array(done_at)), np.array(done_bits, "<u4").tobytes(), b"", b""))
    return to_table(SEND_SCHEMA, out)


def gram_hashes_of(grams: np.ndarray) -> np.ndarray:
    """gram_hashes of rows of GRAM bytes."""
    word = lambda at: np.ascontiguousarray(grams[:, at : at + 8]).view("<u8").ravel()
    h = word(0) * M1
    h ^= h >> np.uint64(29)
    h += word(8) * M2
    h ^= h >> np.uint64(31)
    h *= M3
    h ^= (word(GRAM - 8) * M1) >> np.uint64(17)
    h *= M2
    return h ^ (h >> np.uint64(32))


def common_prefix_at_least(data: bytes, array: np.ndarray, width: int) -> np.ndarray:
    """For each suffix but the first in order, whether it shares its first `width` bytes with the one before; all have so many."""
    words = words_at(data)
    alike = np.ones(len(array) - 1, dtype=bool)
    for k in [*range(0, width - 8, 8), width - 8]:
        at = words[array + k]
        alike &= at[1:] == at[:-1]
    return alike


def smallest_elsewhere(strings: list[bytes], orders: np.ndarray, width: int, in_memory: int = IN_MEMORY) -> np.ndarray:
    """strings x starts: the smallest order of all strings that hold the `width` bytes from there on, LAST past the end."""
    lengths = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    # Symbols: 0 ends the text, 1 ends a string, a byte counts 2 more.
    data = b"\0".join(strings)
    text = np.frombuffer(data, np.uint8).astype(np.int16) + 2
    ends = np.cumsum(lengths + 1)[:-1] - 1
    text[ends] = 1
    text = np.concatenate([text, np.array([1] * (width + 1) + [0], np.int16)])
    starts = np.r_[0, ends + 1]
    array = suffix_array(text, 258, width + 14, in_memory)
    owner = np.full(len(text), -1, np.int32)
    offset = np.zeros(len(text), np.int16)
    counts = lengths - width + 1
    flat = np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    owner[flat] = np.repeat(np.arange(len(strings)), counts)
    offset[flat] = flat - starts[owner[flat]]
    array = array[owner[array] >= 0]
    owner, offset = owner[array], offset[array]
    first = np.flatnonzero(np.r_[True, ~common_prefix_at_least(data, array, width)])
    least = np.minimum.reduceat(orders[owner], first)
    out = np.full((len(strings), int(counts.max())), LAST)
    out[owner, offset] = np.repeat(least, np.diff(first, append=len(array)))
    return out


def sort_shard(rows: pa.Table, width: int) -> pa.Table:
    """Sorts a shard's strings and tells each block which starts an earlier document has."""
    out: list[tuple] = []
    strings: dict[bytes, int] = {}
    orders: list[int] = []
    asked = []
    for b, k, x, y, o, t in zip(*(rows.column(c).to_pylist() for c in ("block", "kind", "x", "y", "ords", "texts")), strict=True):
        if k == 2:
            out.append((b, REMOVE, 0, x, y))
            continue
        lengths, counts = np.frombuffer(x, "<u4").reshape(2, -1)
        mine, index, at = np.frombuffer(o, "<i8"), [], 0
        for n, order in zip(lengths.tolist(), mine.tolist(), strict=True):
            s = t[at : at + n]
            at += n
            i = strings.setdefault(s, len(strings))
            if i == len(orders):
                orders.append(order)
            elif order < orders[i]:
                orders[i] = order
            index.append(i)
        asked.append((b, np.array(index), mine, counts, np.frombuffer(y, PLACE)))
    if strings:
        least = smallest_elsewhere(list(strings), np.array(orders, np.int64), width)
        weight = np.uint64(1) << np.arange(least.shape[1], dtype=np.uint64)
        for b, index, mine, counts, refs in asked:
            bits = ((least[index] < mine[:, None]) * weight).sum(axis=1).astype("<u4")
            each = np.repeat(bits, counts)
            if (hit := each > 0).any():
                out.append((b, REMOVE, 0, refs[hit].tobytes(), each[hit].tobytes()))
    return to_table(MAIL_SCHEMA, out)


def cut(data: bytes, starts: np.ndarray, bits: np.ndarray, width: int, joiner: bytes | None = None) -> tuple[bytes, int, int]:
    """What stays, and the number of bytes and of runs that repeated strings cover.

    With a joiner, a character stays unless all its bytes are covered, and what a run parted is joined with it where no
    white space does it.
    """
    edge = np.zeros(len(data) + 1, np.int64)
    which, shift = np.nonzero((bits[:, None] >> np.arange(32, dtype=np.uint32)) & 1)
    at = np.unique(starts[which] + shift)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    gone = np.cumsum(edge[:-1]) > 0
    removed, runs_ = int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum())
    raw = np.frombuffer(data, np.uint8)
    if joiner is None:
        return raw[~gone].tobytes(), removed, runs_
    heads = np.flatnonzero((raw & 0xC0) != 0x80)
    whole = np.repeat(np.logical_and.reduceat(gone, heads), np.diff(np.r_[heads, len(raw)]))
    stops = np.flatnonzero(np.diff(np.r_[True, whole, True].astype(np.int8)))
    parts = [data[i:j] for i, j in zip(stops[::2].tolist(), stops[1::2].tolist(), strict=True)]
    out = parts[:1]
    for p in parts[1:]:
        out.append(p if out[-1][-1:].isspace() or p[:1].isspace() else joiner + p)
    return b"".join(out), removed, runs_


def remove_repeats(
    docs: DataFrame, width: int = 50, block_chars: int = BLOCK_CHARS, shard_chars: int = SHARD_CHARS, joiner: str | None = None, crowd: int = CROWD
) -> DataFrame:
    """The rows of docs(doc_id, text, ...) with n_bytes, n_removed, n_spans and kept, the bytes that stay.

    A byte of a text's UTF-8 goes if it lies in a string of `width` bytes (32 bits of starts allow GRAM < width < 52) that
    also starts in a text of a smaller doc_id, judged on the input. A null text counts as empty, a null id as larger than
    all others; rows of equal ids don't remove each other's bytes. Repeated rows with different ids are copies: all
    but the first lose everything. An empty table gives no rows. Other columns are kept, but for those named as the four.
    With a joiner, kept holds whole characters, and it stands between what a removed run parted unless white space does.
    """
    require(docs, "doc_id", "text")
    if not GRAM < width <= GRAM + 31:
        raise ValueError("width must be above 20 and at most 51")
    docs = docs.select(*[c for c in docs.columns if c not in RESULTS])
    spark = docs.sparkSession
    shards = max(scan_parts(spark), blocks_for(docs, "text", block_chars) * block_chars // shard_chars)
    fields = docs.schema.fields
    names = [f"c{i}" for i in range(len(fields))]
    at_id, text = docs.columns.index("doc_id"), f"c{docs.columns.index('text')}"
    base = docs.toDF(*names).withColumn("ord", F.coalesce(F.col(f"c{at_id}").cast("long"), F.lit(LAST)))
    key_schema = pa.schema([("block", pa.int64()), ("rid", pa.int64()), ("ord", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])

    def keys(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        table = unpacked(block)
        data = [(t.as_py() or "").encode("utf-8", "replace") for t in table.column(text)]
        at = [i for i, d in enumerate(data) if len(d) >= width]
        both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[i]) for i in at), "<i8").reshape(-1, 2)
        found = batch(key_schema, block=[key[0].as_py()] * len(at), rid=at, ord=table.column("ord").to_numpy()[at], k1=both[:, 0], k2=both[:, 1])
        return tidy(pa.Table.from_batches([found]))

    slim = packed(base, text, block_chars)
    keyed = slim.groupBy("block").applyInArrow(keys, "block long, rid long, ord long, k1 long, k2 long")
    firsts = keyed.groupBy(F.col("k1").alias("f1"), F.col("k2").alias("f2")).agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    none = F.lit(None).cast("binary")
    firsts = firsts.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    same = (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")) & (F.col("r") == F.col("salt"))
    copies = keyed.withColumn("r", F.expr(f"cast(pmod(block + rid, {SALTS}) AS int)")).join(firsts, same).filter("ord > first")
    copies = copies.select(F.col("block").alias("block"), F.lit(COPY).alias("kind"), F.col("rid").alias("rid"), none.alias("x"), none.alias("y"))

    def texts_of(table: pa.Table) -> list[str]:
        return table.column(text).to_pylist()

    def ask(key: tuple[pa.Scalar, ...], block: pa.Table, mail: pa.Table) -> pa.Table:
        table = unpacked(block)
        return tidy(ask_anchors(key[0].as_py(), texts_of(table), first_of_copies(table.num_rows, mail), table.column("ord").to_numpy(), shards, width))

    def send(key: tuple[pa.Scalar, ...], block: pa.Table, mail: pa.Table) -> pa.Table:
        table = unpacked(block)
        return tidy(send_strings(key[0].as_py(), texts_of(table), table.column("ord").to_numpy(), mail, shards, width))

    def answer(rows: pa.Table) -> pa.Table:
        return tidy(answer_anchors(rows, crowd))

    def sort(rows: pa.Table) -> pa.Table:
        return tidy(sort_shard(rows, width))

    results = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, fields, strict=True)] + results)

    def finish(key: tuple[pa.Scalar, ...], block: pa.Table, mail: pa.Table) -> pa.Table:
        table = unpacked(block)
        own = first_of_copies(table.num_rows, mail)
        gone: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        hits = [(np.frombuffer(x, PLACE), np.frombuffer(y, "<u4")) for k, x, y in zip(*(mail.column(c).to_pylist() for c in ("kind", "x", "y")), strict=True) if k == REMOVE]
        if hits:
            refs, bits = np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])
            gone = {i: (refs["at"][p].astype(np.int64), bits[p]) for i, p in runs(refs["row"].astype(np.int64))}
        sizes, removed, spans, kept = [], [], [], []
        for i, t in enumerate(table.column(text)):
            data = (t.as_py() or "").encode("utf-8", "replace")
            rest = (data, 0, 0)
            if not own[i]:
                rest = (b"", len(data), 1)
            elif i in gone:
                rest = cut(data, *gone[i], width, joiner and joiner.encode())
            sizes.append(len(data))
            kept.append(rest[0])
            removed.append(rest[1])
            spans.append(rest[2])
        long = pa.int64()
        return tidy(pa.table([*table.select(names).columns, pa.array(sizes, long), pa.array(removed, long), pa.array(spans, long), pa.array(kept, pa.binary())], names=[*names, "n_bytes", "n_removed", "n_spans", "kept"]))

    asked = slim.groupBy("block").cogroup(copies.groupBy("block")).applyInArrow(ask, ASK)
    hot = asked.groupBy("shard").applyInArrow(answer, MAIL)
    sent = slim.groupBy("block").cogroup(hot.groupBy("block")).applyInArrow(send, SEND)
    marks = sent.groupBy("shard").applyInArrow(sort, MAIL)
    out = slim.groupBy("block").cogroup(copies.unionByName(marks).groupBy("block")).applyInArrow(finish, schema)
    return out.toDF(*docs.columns, "n_bytes", "n_removed", "n_spans", "kept")


REPEATS_SQL = """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), starts AS (
  SELECT doc_id, b, unnest(range(1, n - 48)) AS i FROM d
), strings AS (
  SELECT doc_id, i, array_slice(b, i, i + 49) AS s FROM starts
), hits AS (
  SELECT doc_id, i FROM strings JOIN (SELECT s, min(doc_id) AS first FROM strings GROUP BY s) USING (s) WHERE doc_id > first
), numbered AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
    SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS fresh FROM hits)
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 49 AS z FROM numbered GROUP BY doc_id, g
), pieces AS (
  SELECT doc_id, a, hex(array_slice(b, 1 + coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0), a - 1)) AS h FROM spans JOIN d USING (doc_id)
  UNION ALL
  SELECT doc_id, max(n) + 1, hex(array_slice(any_value(b), 1 + max(z), max(n))) FROM spans JOIN d USING (doc_id) GROUP BY doc_id
), kept AS (
  SELECT doc_id, unhex(string_agg(h, '' ORDER BY a)) AS k FROM pieces GROUP BY doc_id
), sums AS (
  SELECT doc_id, count(*) AS n_spans, CAST(sum(z - a + 1) AS BIGINT) AS n_removed FROM spans GROUP BY doc_id
)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(k, b)) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
