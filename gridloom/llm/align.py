"""Alignment of two tokenizers: token ends of either are joined, common ends cut the text into groups, overlaps are links."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from gridloom.llm.common import batch, blocks, bucketed, materialize, require, scan_parts, tidy

#: Characters of a block of documents, rows that are packed at a time, and id pairs that are broadcast at most.
SPAN, HELD, PAIRS = 1 << 25, 1 << 17, 1 << 19
#: A part of a text ends before spaces, unless white space (or the sign that stands for it in pieces) comes before them, or nothing after.
MARK = "▁"
SEAM = re.compile(rf"(?<=[^\s{MARK}])(?= +[^ ])")


def byte_level() -> dict[str, int]:
    """The bytes that byte-level vocabularies write as characters: printable ones as they are, others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Side:
    """A tokenizer file: ids of texts, and the bytes of each id. A .json file is read as byte-level BPE, a .model file with sentencepiece."""

    def __init__(self, path: str):
        self.adds_space = path.endswith(".model")
        self.faithful = False
        if self.adds_space:
            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
            single = [self.model.is_byte(i) for i in range(len(pieces))]
            self.bytes = [bytes([int(p[3:5], 16)]) if one else p.replace(MARK, " ").encode() for p, one in zip(pieces, single, strict=True)]
            self.seams = not any(re.search(rf"[^\s{MARK}][ {MARK}]", p) for p in pieces)
            spec = sentencepiece_model_pb2.ModelProto.FromString(self.model.serialized_model_proto()).normalizer_spec
            # Nothing is rewritten but spaces, and what has no piece is spelled in bytes.
            plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.add_dummy_prefix and spec.escape_whitespaces
            self.faithful = plain and sum(single) == 256
        else:
            self.model = Tokenizer.from_file(path)
            self.model.encode_special_tokens = True
            letters = byte_level()
            words = self.model.get_vocab(with_added_tokens=True)
            self.bytes = [b""] * (max(words.values(), default=-1) + 1)
            for word, i in words.items():
                self.bytes[i] = bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()
            self.faithful = self.model.normalizer is None and all(c in words for c in letters)
            self.seams = not any(re.search(rf"[^\s{MARK}] ", b.decode("utf-8", "replace")) for b in self.bytes)

    def encode(self, parts: list[str]) -> list[list[int]]:
        """Ids of a space and each part."""
        if self.adds_space:
            return self.model.encode(parts, num_threads=1)
        return [e.ids for e in self.model.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]


@lru_cache(maxsize=4)
def side(path: str) -> Side:
    return Side(path)


def spelled(parts: list[str], a: Side, b: Side) -> np.ndarray:
    """Whether both tokenizers spell a space and the part exactly. Pieces of a faithful model do unless the part has their sign for a space."""
    if a.faithful and b.faithful:
        return np.array([MARK not in p for p in parts], dtype=bool)
    same = [[b"".join([s.bytes[i] for i in x]) == (" " + p).encode() for p, x in zip(parts, s.encode(parts), strict=True)] for s in (a, b)]
    return np.logical_and(*(np.array(x, dtype=bool) for x in same))


class Numbers(dict):
    """Numbers things in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def cut(text: str, seams: bool, numbers: Numbers) -> list[int]:
    """A space and the text as the numbers of its parts, each without its first space."""
    if not seams:
        return [numbers[text]]
    parts = text.split(" ")
    if all(parts) and not any(p[-1] == MARK or p[-1].isspace() for p in parts[:-1]):
        return [numbers[p] for p in parts]
    return [numbers[p[1:]] for p in SEAM.split(" " + text)]


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session that holds inside only."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def parts_of(docs: DataFrame, first: str, second: str, span: int) -> DataFrame:
    """block, docs for each block of docs(doc_id, text): its documents as lists of part numbers, packed; block, part, at, n for each distinct part of a block.

    A document with a part that either tokenizer doesn't spell exactly has no parts.
    """
    kind = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("part", pa.string()), ("at", pa.int32()), ("n", pa.int64())])
    whole = pa.schema([("doc_id", pa.int64()), ("at", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = side(first), side(second)
        seams = a.seams and b.seams
        for block, rows in blocks(batches, "text", span):
            numbers = Numbers()
            lists = [np.array(cut(t, seams, numbers) if t else [], dtype=np.int32) for t in rows.column("text").to_pylist()]
            parts = list(numbers)
            sound = np.empty(len(parts), bool)
            for s in range(0, len(parts), 10_000):
                sound[s : s + 10_000] = spelled(parts[s : s + 10_000], a, b)
            if not sound.all():
                lists = [x if sound[x].all() else x[:0] for x in lists]
            n = np.bincount(np.concatenate(lists), minlength=len(parts)) if lists else np.zeros(0, np.int64)
            ends = np.cumsum([0, *map(len, lists)])
            table = pa.table([rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists)))], schema=whole)
            yield batch(kind, block=[block], docs=[sealed(table)], part=[None], at=[None], n=[None])
            kept = np.flatnonzero(n)
            for s in range(0, len(kept), 50_000):
                at = kept[s : s + 50_000]
                yield batch(kind, block=np.full(len(at), block), docs=[None] * len(at), part=[parts[i] for i in at], at=at.astype(np.int32), n=n[at])
            del numbers, parts, lists
            tidy(None)

    return docs.mapInArrow(run, "block long, docs binary, part string, at int, n long")


def encoded(parts: DataFrame, first: str, second: str) -> DataFrame:
    """part, n, and a, b: ids of the tokens of a space and each part."""

    @F.arrow_udf("struct<a: array<int>, b: array<int>>")
    def ids(texts: pa.Array) -> pa.Array:
        lists = [pa.array(side(p).encode(texts.to_pylist()), pa.list_(pa.int32())) for p in (first, second)]
        return pa.StructArray.from_arrays(lists, names=["a", "b"])

    return parts.withColumn("t", ids("part")).select("part", "n", "t.a", "t.b")


def lengths(spark: SparkSession, *paths: str) -> DataFrame:
    """side, id, len: how many bytes each token of each vocabulary has."""
    rows = [(k, i, len(b)) for k, p in enumerate(paths) for i, b in enumerate(side(p).bytes)]
    return spark.createDataFrame(pa.table([pa.array(c, pa.int32()) for c in zip(*rows, strict=True)], names=["side", "id", "len"]))


def token_links(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """part, n, end, a_own, b_own, gid, a, b: the tokens of each of tokens(part, n, a, b), laid upon each other; a row for each link.

    Tokens are exploded, and their lengths summed up to ends. The ends of both sides are joined by part and end: each distinct end closes one
    overlap, of the tokens of either side that end there or next after it. Ends of both sides are cuts; their running
    count, from the end, numbers the groups.

    Both sides lie in one exchange by part, so the join is a grouping by part and end, and needs none of its own. The broadcast has a row per id.
    """
    tagged = lambda c, k: F.transform(c, lambda i: F.struct(F.lit(k).alias("side"), i.alias("id")))
    each = tokens.repartition(scan_parts(tokens.sparkSession), "part").select("part", "n", F.posexplode(F.concat(tagged("a", 0), tagged("b", 1))).alias("pos", "t"))
    each = each.select("part", "n", "pos", "t.side", "t.id").join(F.broadcast(vocabulary), ["side", "id"])
    ends = each.select("part", "n", "side", "id", F.sum("len").over(W.partitionBy("part", "side").orderBy("pos")).alias("end"))
    own = {c: F.max(F.when(F.col("side") == k, F.col("id"))).alias(f"{c}_own") for k, c in enumerate("ab")}
    joined = ends.groupBy("part", "end").agg(F.max("n").alias("n"), *own.values())
    back = W.partitionBy("part").orderBy(F.col("end").desc())
    common = F.when(F.col("a_own").isNotNull() & F.col("b_own").isNotNull(), 1)
    links = joined.select("part", "n", "end", "a_own", "b_own", F.count(common).over(back).alias("gid"), *[F.last(f"{c}_own", ignorenulls=True).over(back).alias(c) for c in "ab"])
    # A part's links lie together, the last first.
    return links.sortWithinPartitions("part", F.col("end").desc())


LINKED = pa.schema([("part", pa.string()), ("n", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "groups")], ("text", pa.string()), *[(c, pa.list_(pa.int32())) for c in "ab"]])


def by_part(links: DataFrame) -> DataFrame:
    """part, n, n_a, n_b, groups, text, a, b: a row for each part of links, sorted as token_links does, with its groups `a1,a2|b1;a3|b2,b3` as text and the links' ids as lists."""

    def close(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        """The parts that are whole, and the rows of the part that may go on."""
        codes = rows.column("part").combine_chunks().dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        end = rows.num_rows if last else int(starts[-1])
        starts = starts if last else starts[:-1]
        if not len(starts):
            return None, rows
        whole = rows.slice(0, end)
        a_own, b_own = (whole.column(f"{c}_own").to_pylist() for c in "ab")
        gid = whole.column("gid").to_numpy()
        texts, n_a, n_b = [], [], []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), end], strict=True):
            first, second, groups = [], [], []
            for k in range(e - 1, s - 1, -1):
                if a_own[k] is not None:
                    first.append(str(a_own[k]))
                if b_own[k] is not None:
                    second.append(str(b_own[k]))
                if k == s or gid[k - 1] != gid[k]:
                    groups.append((first, second))
                    first, second = [], []
            texts.append(";".join([",".join(x) + "|" + ",".join(y) for x, y in groups]))
            n_a.append(sum([len(x) for x, _ in groups]))
            n_b.append(sum([len(y) for _, y in groups]))
        offsets = pa.array(np.append(starts, end), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, whole.column(c).combine_chunks()) for c in "ab"]
        out = [whole.column("part").take(pa.array(starts)).combine_chunks(), whole.column("n").take(pa.array(starts)).combine_chunks(), *[pa.array(x, pa.int64()) for x in (n_a, n_b, gid[np.append(starts[1:], end) - 1])], pa.array(texts, pa.string()), *lists]
        return pa.RecordBatch.from_arrays(out, schema=LINKED), rows.slice(end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in batches:
            part = pa.Table.from_batches([part])
            made, held = close(part if held is None else pa.concat_tables([held, part]), False)
            if made is not None:
                yield made
        if held is not None and held.num_rows:
            yield close(held, True)[0]

    return links.mapInArrow(run, "part string, n long, n_a long, n_b long, groups long, text string, a array<int>, b array<int>")


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
ANSWERS = pa.schema([("at", pa.int32()), *[(c, pa.int64()) for c in ("n_a", "n_b", "groups", "links", "best", "counts")], ("text", pa.string())])


def sealed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as to:
        to.write_table(table)
    return zstandard.ZstdCompressor(level=9).compress(memoryview(sink.getvalue()))


def opened(column: pa.ChunkedArray) -> list[pa.Table]:
    return [pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(x.as_buffer())).read_all() for x in column]


def packed_answers(rows: DataFrame) -> DataFrame:
    """asker, told: what a task has for each block, packed, some rows at a time."""
    columns = ["asker", *ANSWERS.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).sort_by("asker")
            held.clear()
            asker = table.column("asker").to_numpy()
            cuts = [0, *(np.flatnonzero(asker[1:] != asker[:-1]) + 1).tolist(), len(asker)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                yield batch(kind, asker=[int(asker[s])], told=[sealed(table.slice(s, e - s).select(ANSWERS.names).cast(ANSWERS))])

        kind = pa.schema([("asker", pa.int64()), ("told", pa.binary())])
        for part in batches:
            held.append(part)
            if sum(x.num_rows for x in held) >= HELD:
                yield from flush()
        if held:
            yield from flush()

    return rows.select(*columns).mapInArrow(run, "asker long, told binary")


def align(docs: DataFrame, first: str, second: str, doc_id: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups for every row of docs: how its tokens by two tokenizers lie upon each other.

    first: path of a byte-level BPE (.json), which reads a space and the text; second: of a sentencepiece model (.model), which adds the
    space itself. Special tokens aren't recognised in texts. Groups are the stretches between common token ends, as text `a1,a2|b1;a3|b2,b3`. A
    link is a pair of overlapping tokens; the count of an id pair is the number of its links in all documents. n_best: links
    whose count is the highest of their second id, ties included; count_sum: the counts of all links.

    A text that is null, empty, or not spelled exactly by both has no tokens: zeros, and empty groups; it adds to no count. Repeated rows
    count each; a null id stays null; an empty table gives no rows; other columns are ignored.

    Both tokenizers always cut before spaces that come after a character that isn't white space (their vocabularies are searched for entries that
    would not; with one, texts stay whole). So a text is a list of parts, and tokens are exploded, summed, joined and linked
    once for each distinct part, weighted by its occurrences. Blocks of documents ask for their parts' rows, once per
    distinct part; no token, and no text, is shuffled by document. A part of any length is a group of its own, in sorted runs that can spill.
    """
    require(docs, doc_id, text)
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with setting(spark, "spark.sql.parquet.compression.codec", "zstd"):
        # A task's blocks go to files of their own, so that what is asked for can come to them.
        cuts = bucketed(parts_of(rows, first, second, span), "parts", scan_parts(spark), "block")
        asked = cuts.filter("docs IS NULL").select(F.col("block").alias("asker"), "part", "at", "n")
        distinct = asked.groupBy("part").agg(F.sum("n").alias("n"))
        found = token_links(encoded(distinct, first, second), lengths(spark, first, second))
        linked = bucketed(by_part(found), "links", scan_parts(spark), "part")
    exploded = linked.select("part", "n", F.explode(F.arrays_zip("a", "b")).alias("l")).select("part", "n", "l.a", "l.b")
    pairs = materialize(exploded.groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    best = pairs.groupBy("b").agg(F.max("count").alias("best"))
    ranked = pairs.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("best")).cast("long").alias("best"))
    ranked = F.broadcast(ranked) if pairs.count() <= PAIRS else ranked
    scores = exploded.join(ranked, ["a", "b"]).groupBy("part").agg(F.count(F.lit(1)).alias("links"), F.sum("best").alias("best"), F.sum("count").alias("counts"))
    told = linked.select("part", "n_a", "n_b", "groups", "text").join(scores, "part")
    answers = packed_answers(asked.select("asker", "part", "at").join(told, "part").drop("part"))
    kind = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in NUMBERS], ("groups", pa.string())])

    def finish(held: pa.Table, told: pa.Table) -> pa.Table:
        """A block's documents, from the rows of its parts."""
        rows = opened(held.column("docs"))[0].combine_chunks()
        told = pa.concat_tables(opened(told.column("told"))) if told.num_rows else ANSWERS.empty_table()
        at = told.column("at").to_numpy()
        size = int(at.max(initial=-1)) + 1
        lists = rows.column("at").combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
        texts = np.empty(size, object)
        texts[at] = told.column("text").to_pylist()
        value = np.zeros((size, len(NUMBERS)), np.int64)
        for k, c in enumerate(("n_a", "n_b", "groups", "links", "best", "counts")):
            value[at, k] = told.column(c).to_numpy()
        sums = np.array([value[flat[s:e]].sum(0) for s, e in zip(ends[:-1], ends[1:], strict=True)]).reshape(-1, len(NUMBERS))
        joined = pa.array((";".join(texts[flat[s:e]].tolist()) for s, e in zip(ends[:-1], ends[1:], strict=True)), pa.string())
        return tidy(pa.table([rows.column("doc_id"), *[pa.array(sums[:, k]) for k in range(len(NUMBERS))], joined], schema=kind))

    held = cuts.filter("docs IS NOT NULL").select("block", "docs")
    return held.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(finish, "doc_id long, " + ", ".join(f"{c} long" for c in NUMBERS) + ", groups string")
