"""Quality classification by perplexity under a modified Kneser-Ney model of trusted text.

The model is over characters: n-grams of `order` symbols, counted in all trusted texts. Its tables stay distributed, sharded by
n-gram. Tasks cut the documents that they read into blocks; a block asks for each of its distinct n-grams once,
in packed form, by shards of the n-grams. A shard puts equal requests together; joins with the counts, order by
order, give their probabilities, which go back to the blocks. A document's perplexity is compared with a quantile of the
trusted texts' perplexities in its language. N-grams of characters don't see that words repeat; repetitions beyond those of trusted
texts are charged at their rarity there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batch, blocks, blocks_for, materialize, packed, require, scan_parts, steady, tidy, unpacked

#: Bits of a symbol. Code points from PLAIN on are two symbols, a lead (PLAIN and more) and the low HALF bits, so none share one; PAD stands before a text.
BITS, PLAIN, HALF, PAD = 12, 3072, 11, 4095
#: No discount is less, so that every context leaves some mass to the lower order.
LEAST_DISCOUNT = 0.05
#: Words back to which repetitions are counted.
REACH = 2
ORDER, BLOCK_CHARS, SPAN = 5, 8_000_000, 1 << 20
#: N-grams of a shard of requests.
SHARD = 4_000_000
#: Trusted ids that may be broadcast (some 20 MB); beyond that they are joined by a shuffle.
SMALL = 500_000


def symbols_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points as symbols, and how many each takes."""
    width = 1 + (points >= PLAIN)
    out = np.repeat(points, width)
    lead = np.cumsum(width)[points >= PLAIN] - 2
    out[lead + 1] &= (1 << HALF) - 1
    out[lead] = PLAIN + (out[lead] >> HALF)
    return out, width


def codes(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end at each symbol of texts, as numbers, and how many symbols each text has."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    flat, width = symbols_of(points)
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
    stops = np.r_[0, np.cumsum(width)][ends]
    lengths = np.diff(np.r_[0, stops])
    symbols = np.full(len(flat) + (order - 1) * len(texts), PAD, dtype=np.int64)
    inside = np.zeros(len(symbols), dtype=bool)
    inside[np.arange(len(flat)) + np.repeat((order - 1) * (1 + np.arange(len(texts))), lengths)] = True
    symbols[inside] = flat
    out = symbols.copy()
    for k in range(1, order):
        out[k:] |= symbols[:-k] << (BITS * k)
    return out[inside], lengths


def repeated(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many words each text has, and how many equal one before them and first do so at distance 1, 2, ... REACH."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.cumsum(lengths + 1) - lengths
    points = np.frombuffer((" " + " ".join(texts)).encode("utf-32-le", "replace"), np.uint32)
    blank = (points <= 32) | (points == 0xA0) | (points == 0x3000)
    at = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    near = np.zeros((len(texts), REACH), np.int64)
    if not len(at):
        return np.zeros(len(texts), np.int64), near
    heads = np.r_[0, at]
    place = np.arange(len(points)) - np.repeat(heads, np.diff(np.r_[heads, len(points)]))
    powers = np.cumprod(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    keys = points.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    keys ^= keys >> np.uint64(29)
    keys *= powers[place]
    keys[blank] = 0
    keys, text = np.add.reduceat(keys, at), np.searchsorted(starts, at, "right") - 1
    fresh = np.ones(len(at), dtype=bool)
    for d in range(1, min(REACH, len(at) - 1) + 1):
        same = fresh[d:] & (keys[d:] == keys[:-d]) & (text[d:] == text[:-d])
        near[:, d - 1] = np.bincount(text[d:][same], minlength=len(texts))
        fresh[d:] &= ~same
    return np.bincount(text, minlength=len(texts)), near


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    values = np.sort(values)
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
    return values[first], np.diff(np.r_[first, len(values)])


def spans(texts: list[str]) -> Iterator[list[int]]:
    """Runs of texts of about SPAN characters."""
    now, size = [], 0
    for i, t in enumerate(texts):
        now.append(i)
        size += len(t)
        if size >= SPAN:
            yield now
            now, size = [], 0
    if now:
        yield now


def ngram_counts(texts: DataFrame, order: int) -> DataFrame:
    """code, c: how often each n-gram occurs in texts(text); each task counts what it reads first."""
    schema = pa.schema([("code", pa.int64()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for rows in batches:
            texts = rows.column(0).to_pylist()
            for span in spans(texts):
                new, n = distinct(codes([texts[i] for i in span], order)[0])
                both = np.concatenate([found, new])
                found, at = np.unique(both, return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([counts, n])).astype(np.int64)
                if len(found) > 2_000_000:
                    yield tidy(batch(schema, code=found, c=counts))
                    found, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        yield tidy(batch(schema, code=found, c=counts))

    return texts.select("text").mapInArrow(run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))


class Model:
    """Count tables of a modified Kneser-Ney model: raw counts at the highest order, numbers of different left neighbours below."""

    def __init__(self, counts: DataFrame, order: int):
        self.order = order
        self.tables = {order: materialize(counts, "ngrams")}
        for n in range(order - 1, 0, -1):
            rest = F.col("code").bitwiseAND(F.lit((1 << BITS * n) - 1))
            lower = self.tables[n + 1].select(rest.alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("c"))
            self.tables[n] = materialize(lower, "ngrams")
        self.discounts = {n: self._discounts(t) for n, t in self.tables.items()}
        self.symbols = self.tables[1].count() + 1

    @staticmethod
    def _discounts(table: DataFrame) -> list[float]:
        n1, n2, n3, n4 = table.agg(*[F.coalesce(F.sum((F.col("c") == k).cast("long")), F.lit(0)) for k in (1, 2, 3, 4)]).first()
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        pairs = zip((1, 2, 3), (n1, n2, n3), (n2, n3, n4), strict=True)
        return [min(max(k - (k + 1) * y * b / a, LEAST_DISCOUNT), float(k)) if a else 0.5 for k, a, b in pairs]

    def discount(self, n: int, c: Column) -> Column:
        d1, d2, d3 = self.discounts[n]
        return F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)

    def contexts(self, n: int) -> DataFrame:
        """h, total, back: for each context of order n, its count and the mass that its discounts leave to the lower order."""
        rows = self.tables[n].select(F.shiftright("code", BITS).alias("h"), "c")
        return rows.groupBy("h").agg(F.sum("c").alias("total"), F.sum(F.least(self.discount(n, F.col("c")), F.col("c").cast("double"))).alias("back"))

    def probabilities(self, wanted: DataFrame, n: int | None = None) -> DataFrame:
        """Adds p to wanted(code, ...), whose codes differ.

        What a lower order says is written as a table, so a plan holds the joins of one order only: one plan of all orders takes the
        driver's memory with every stage that ends.
        """
        n = n or self.order
        seen = self.tables[n].select(F.col("code").alias("_code"), "c")
        end = lambda k: F.col("code").bitwiseAND(F.lit((1 << BITS * k) - 1))
        # Join keys are expressions of the code, so that no exchange carries them.
        rows = wanted.join(seen, F.col("code") == F.col("_code"), "left").drop("_code")
        context = self.contexts(n).select(F.col("h").alias("_ctx"), "total", "back")
        rows = rows.join(context, F.shiftright("code", BITS) == F.col("_ctx"), "left").drop("_ctx")
        if n > 1:
            ends = materialize(wanted.select(end(n - 1).alias("code")).distinct(), "ends")
            lower = materialize(self.probabilities(ends, n - 1), "lower").select(F.col("code").alias("_low"), F.col("p").alias("_p"))
            rows = rows.join(lower, end(n - 1) == F.col("_low")).drop("_low")
        else:
            rows = rows.withColumn("_p", F.lit(1.0 / self.symbols))
        c = F.coalesce(F.col("c").cast("double"), F.lit(0.0))
        own = F.when(c > 0, F.greatest(c - self.discount(n, F.col("c")), F.lit(0.0))).otherwise(F.lit(0.0))
        p = F.when(F.col("total").isNull(), F.col("_p")).otherwise((own + F.col("back") * F.col("_p")) / F.col("total"))
        return rows.withColumn("p", p).select(*wanted.columns, "p")


def by_shard(names: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """Sorted names by shard, each part sorted still."""
    shard = (names * np.int64(-7046029254386353131) >> np.int64(20)) % shards
    order = np.argsort(shard.astype(np.int32), kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    return [(int(shard[p[0]]), names[p]) for p in np.split(order, cuts) if len(p)]


def planes(values: np.ndarray) -> bytes:
    """Numbers of one kind with their bytes of equal weight together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def from_planes(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def squeeze(names: np.ndarray) -> bytes:
    """Ascending numbers, as differences."""
    return planes(np.diff(names, prepend=0).astype("<i8"))


def unsqueeze(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, "<i8"))


def names_of(texts: list[str], order: int) -> np.ndarray:
    """The sorted distinct n-grams of a block."""
    found = np.empty(0, np.int64)
    for span in spans(texts):
        found = distinct(np.concatenate([found, distinct(codes([texts[i] for i in span], order)[0])[0]]))[0]
    return found


def perplexities(docs: DataFrame, model: Model, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs(text, ...) without their texts, with perplexity (null for a null or empty text), words and repeats by distance.

    docs is read twice and must give each task the same rows both times, as files do; anything but a projection of a scan
    is written as a table first, and a difference is an error.
    """
    if not steady(docs):
        docs = materialize(docs, "documents")
    spark, order = docs.sparkSession, model.order
    shards = max(scan_parts(spark), blocks_for(docs, "text", block_chars) * 200_000 // SHARD)
    kept = [f for f in docs.schema.fields if f.name != "text"]
    ask_schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("names", pa.binary())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in blocks(batches, "text", block_chars):
            parts = by_shard(names_of([t or "" for t in table.column(0).to_pylist()], order), shards)
            yield tidy(batch(ask_schema, shard=[s for s, _ in parts], block=[block] * len(parts), names=[squeeze(n) for _, n in parts]))

    def unite(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = np.empty(0, np.int64)
        for names in table.column("names").to_pylist():
            found = distinct(np.concatenate([found, unsqueeze(names)]))[0]
        return tidy(pa.table({"code": found, "shard": pa.array(np.full(len(found), key[0].as_py(), np.int32))}))

    def answer(key: tuple[pa.Scalar, ...], asked: pa.Table, known: pa.Table) -> pa.Table:
        names, p = known.column("code").to_numpy(), known.column("p").to_numpy()
        by_name = np.argsort(names)
        names, logs = names[by_name], np.log(p[by_name]).astype("<f4")
        out = [planes(logs[np.searchsorted(names, unsqueeze(x))]) for x in asked.column("names").to_pylist()]
        return tidy(pa.table([asked.column("block"), asked.column("shard"), pa.array(out, pa.binary())], names=["block", "shard", "logs"]))

    def score(key: tuple[pa.Scalar, ...], rows: pa.Table, told: pa.Table) -> pa.Table:
        table = unpacked(rows)
        texts = [t or "" for t in table.column("text").to_pylist()]
        names = names_of(texts, order)
        logs = dict(zip(told.column("shard").to_pylist(), told.column("logs").to_pylist(), strict=True))
        parts = [(n, from_planes(logs[s], "<f4")) for s, n in by_shard(names, shards)]
        if any(len(n) != len(v) for n, v in parts) or len(parts) != len(logs):
            raise RuntimeError("the documents came in another order than before")
        values = np.concatenate([v for _, v in parts]) if parts else np.empty(0, np.float32)
        values = values[np.argsort(np.concatenate([n for n, _ in parts]))].astype(np.float64) if parts else values
        out, words, near = np.full(len(texts), np.nan), np.zeros(len(texts), np.int64), np.zeros((len(texts), REACH), np.int64)
        for span in spans(texts):
            words[span], near[span] = repeated([texts[i] for i in span])
            found, lengths = codes([texts[i] for i in span], order)
            if not len(found):
                continue
            own, at = np.unique(found, return_inverse=True)
            each = np.r_[values[np.searchsorted(names, own)][at], 0.0]
            sums = np.add.reduceat(each, np.minimum(np.cumsum(lengths) - lengths, len(found)))
            real = lengths > 0
            out[np.array(span)[real]] = np.exp(-sums[real] / lengths[real])
        found = {"perplexity": pa.array(out, mask=np.isnan(out)), "words": pa.array(words), **{f"repeats_{d + 1}": pa.array(near[:, d].copy()) for d in range(REACH)}}
        return tidy(pa.table([*[table.column(f.name) for f in kept], *found.values()], names=[*[f.name for f in kept], *found]))

    asked = materialize(docs.select("text").mapInArrow(ask, "shard int, block long, names binary"), "requests")
    wanted = materialize(asked.groupBy("shard").applyInArrow(unite, "code long, shard int"), "wanted")
    known = model.probabilities(wanted)
    told = asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(answer, "block long, shard int, logs binary")
    dealt = packed(docs.select(*[f.name for f in kept], "text"), "text", block_chars)
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "perplexity double", "words long", *[f"repeats_{d} long" for d in range(1, REACH + 1)]])
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, fields)


def classify(docs: DataFrame, trusted: DataFrame, order: int = ORDER, quantile: float = 0.99, slack: float = 1.12, folds: int = 5, block_chars: int = BLOCK_CHARS, key: str | None = None) -> DataFrame:
    """doc_id, lang, perplexity, threshold, keep for every row of docs(doc_id, text, lang).

    trusted(doc_id) names documents to rely on. The model is trained on their whole texts but for one fold in `folds`, by a
    hash of the id; that fold, which the model hasn't seen, sets the thresholds. A document stays if its perplexity is at
    most `slack` times the `quantile` of the fold's perplexities in its language. As the mean over a short text
    strays further, both sides are compared after division by exp(1 / sqrt(characters)). A word that equals the one or two words before
    it costs the negative logarithm of such words' share in the training texts; by what this cost per character, less 1 / sqrt(characters),
    exceeds the `quantile` of the fold, the logarithm of the perplexity is raised. A null language is one of its
    own; a language without a trusted text in the fold takes the quantile of all. A null or empty text has no perplexity and
    goes. Without any trusted text in the fold there is no threshold and all other documents stay. Repeated rows get
    equal results, unknown and repeated trusted ids do no harm, an empty table gives no rows, other columns are ignored, but
    for `key`, a column of longs that is handed through.
    """
    require(docs, "doc_id", "text", "lang")
    ids = trusted.select(F.col("doc_id").cast("long").alias("_id")).filter("_id IS NOT NULL").distinct()
    if ids.count() <= SMALL:
        ids = F.broadcast(ids)
    named = [F.col(key).cast("long").alias("row_key")] if key else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", *named)
    sets_limit = F.pmod(F.xxhash64("doc_id"), F.lit(folds)) == 0
    learned = rows.filter(~sets_limit & (F.col("text") != "")).join(ids, F.col("doc_id") == F.col("_id"), "left_semi")
    model = Model(ngram_counts(learned, order), order)
    scored = perplexities(rows.select("doc_id", "lang", F.length("text").alias("chars"), "text", *(["row_key"] if key else [])), model, block_chars)
    role = F.when(F.col("_id").isNull(), 0).when(sets_limit, 2).otherwise(1)
    known = trusted.select(F.col("doc_id").cast("long").alias("_id")).filter("_id IS NOT NULL").distinct()
    scored = materialize(scored.join(known, F.col("doc_id") == F.col("_id"), "left").withColumn("role", role).drop("_id"), "perplexities")
    allowed = F.exp(F.lit(1.0) / F.sqrt(F.greatest(F.col("chars"), F.lit(1)).cast("double")))
    rates = scored.filter("role = 1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", *[f"repeats_{d}" for d in range(1, REACH + 1)])]).first()
    costs = [-math.log((n + 0.5) / (rates[0] + 1)) if rates[0] else 0.0 for n in rates[1:]]
    length = F.greatest(F.col("chars"), F.lit(1)).cast("double")
    cost = sum((F.col(f"repeats_{d}") * F.lit(max(c, 0.0)) for d, c in enumerate(costs, 1)), F.lit(0.0)) / length
    scored = scored.withColumn("_cost", F.greatest(cost - 1.0 / F.sqrt(length), F.lit(0.0)))
    usual = scored.filter("role = 2 AND perplexity IS NOT NULL").agg(F.percentile_approx("_cost", quantile, 10000)).first()[0]
    scored = scored.withColumn("perplexity", F.col("perplexity") * F.exp(F.greatest(F.col("_cost") - F.lit(usual).cast("double"), F.lit(0.0))))
    sure = scored.filter("role = 2 AND perplexity IS NOT NULL").withColumn("even", F.col("perplexity") / allowed)
    limits = sure.groupBy("lang").agg(F.percentile_approx("even", quantile, 10000).alias("own"))
    overall = sure.agg(F.percentile_approx("even", quantile, 10000).alias("every")).first()["every"]
    limits = limits.select(F.col("lang").alias("_lang"), "own")
    joined = scored.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    limit = F.coalesce(F.col("own"), F.lit(overall).cast("double")) * slack * allowed
    keep = F.col("perplexity").isNotNull() & (F.col("perplexity") <= F.coalesce(limit, F.lit(float("inf"))))
    return joined.select("doc_id", "lang", "perplexity", limit.alias("threshold"), keep.alias("keep"), *([F.col("row_key").alias(key)] if key else []))
