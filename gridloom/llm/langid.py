"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its three letters' vectors, the first
permuted (rolled) twice and the second once. A text's profile bundles (adds) the vectors of its trigrams, a language's
prototype those of all training texts in it. A text gets the language whose prototype has the largest cosine with its profile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batch, require

GAP = 0x20
#: Code points that are handled at a time.
SPAN = 1 << 20


class Space:
    """Letter and trigram vectors, made when first met from the letters' code points and the seed alone."""

    def __init__(self, dims: int, seed: int, limit: int = 60_000):
        self.dims, self.seed, self.limit = dims, seed, limit
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((1024, dims), dtype=np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dims, dtype=np.int8)
            self.letters[code] = 2 * bits - 1
        return self.letters[code]

    def trigram(self, code: int) -> np.ndarray:
        a, b, c = code >> 42, (code >> 21) & 0x1FFFFF, code & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def place(self, codes: np.ndarray) -> np.ndarray:
        """Rows of the table of trigram vectors; the table starts anew when it is full."""
        new = [c for c in codes.tolist() if c not in self.rows]
        if len(self.rows) + len(new) > self.limit:
            self.rows, new = {}, codes.tolist()
        if len(self.rows) + len(new) > len(self.vectors):
            grown = np.empty((max(2 * len(self.vectors), len(self.rows) + len(new)), self.dims), dtype=np.int8)
            grown[: len(self.rows)] = self.vectors[: len(self.rows)]
            self.vectors = grown
        for c in new:
            self.vectors[len(self.rows)] = self.trigram(c)
            self.rows[c] = len(self.rows)
        return np.fromiter(map(self.rows.__getitem__, codes.tolist()), dtype=np.int64, count=len(codes))

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dims)
        for i in range(0, len(codes), 8192):
            rows = self.place(codes[i : i + 8192])
            total += counts[i : i + 8192].astype(np.float32) @ self.vectors[rows].astype(np.float32)
        return total


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes (three code points of 21 bits) of all texts, and the number of the text that each comes from.

    Letters are lower-cased; a run of anything else is one gap, and a text starts and ends with a gap.
    """
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    joined = " ".join(texts).lower() if all(len(t) == len(t.lower()) for t in texts) else None
    if joined is None:
        texts = [t.lower() for t in texts]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        joined = " ".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    seen = np.zeros(0x110000, dtype=bool)
    seen[points] = True
    kept = np.full(0x110000, GAP, dtype=np.int32)
    for p in np.flatnonzero(seen).tolist():
        if chr(p).isalpha():
            kept[p] = p
    points = kept[points].astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths + (np.arange(len(texts)) < len(texts) - 1))
    points = np.concatenate(([GAP], points, [GAP]))
    owner = np.concatenate(([0], owner, [len(texts) - 1]))
    stay = np.ones(len(points), dtype=bool)
    stay[1:] = (points[1:] != GAP) | (points[:-1] != GAP)
    points, owner = points[stay], owner[stay]
    if len(points) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
    inner = points[1:-1] != GAP
    return codes[inner], owner[1:-1][inner]


def spans(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SPAN code points."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SPAN:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def prototypes(labelled: DataFrame, dims: int, seed: int) -> tuple[list[str], np.ndarray]:
    """Bundles all texts of labelled(text, lang) by language: one row per language, sorted by name.

    Trigrams are counted within each partition and bundled there, so a partition ships one vector per language.
    """
    schema = pa.schema([("lang", pa.string()), ("bundle", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(dims, seed), {}
        for rows in batches:
            texts = [t or "" for t in rows.column(0).to_pylist()]
            langs = np.array(rows.column(1).to_pylist(), dtype=object)
            for i, j in spans(texts):
                codes, owner = trigrams(texts[i:j])
                names, index = np.unique(langs[i:j].astype(str), return_inverse=True)
                lang_of = index[owner] if len(owner) else owner
                for k, name in enumerate(names):
                    found, counts = np.unique(codes[lang_of == k], return_counts=True)
                    sums[name] = sums.get(name, 0) + space.bundle(found, counts)
        yield batch(schema, lang=list(sums), bundle=[np.asarray(v) for v in sums.values()])

    parts = labelled.select("text", "lang").mapInArrow(run, "lang string, bundle array<double>")
    spread = parts.select("lang", F.posexplode("bundle").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    rows = spread.collect()  # languages x dims numbers, whatever the number of documents
    names = sorted({r["lang"] for r in rows})
    out = np.zeros((len(names), dims))
    at = {n: k for k, n in enumerate(names)}
    for r in rows:
        out[at[r["lang"]], r["i"]] = r["v"]
    return names, out


def identify(docs: DataFrame, names: list[str], protos: np.ndarray, dims: int, seed: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text, held_out)."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
    norms = np.linalg.norm(protos, axis=1, keepdims=True) if len(names) else np.ones((0, 1))
    unit = (protos / np.where(norms > 0, norms, 1)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(dims, seed)
        for rows in batches:
            texts = [t or "" for t in rows.column(1).to_pylist()]
            best, score = ["und"] * len(texts), [0.0] * len(texts)
            for i, j in spans(texts):
                codes, owner = trigrams(texts[i:j])
                if not len(codes) or not names:
                    continue
                shared, index = np.unique(codes, return_inverse=True)
                pairs, counts = np.unique(owner * len(shared) + index, return_counts=True)
                who, which = np.divmod(pairs, len(shared))
                cuts = np.flatnonzero(np.diff(who)) + 1
                for k, c, n in zip(who[np.r_[0, cuts]], np.split(which, cuts), np.split(counts, cuts), strict=True):
                    profile = space.bundle(shared[c], n)
                    size = np.linalg.norm(profile)
                    cosines = unit @ profile / size if size else np.zeros(len(names))
                    top = int(np.argmax(cosines))
                    best[i + k], score[i + k] = names[top], float(min(1.0, max(0.0, cosines[top])))
            yield batch(schema, doc_id=rows.column(0), held_out=rows.column(2), lang_pred=best, score=score)

    return docs.select(F.col("doc_id").cast("long"), "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def detect_languages(docs: DataFrame, dims: int = 1024, seed: int = 7, folds: int = 3, fold: int = 1) -> DataFrame:
    """Predicts the language of every document; learns from the labelled ones outside the held-out fold.

    docs(doc_id, text, lang). A row is held out if crc32 of its id's digits is `fold` modulo `folds` (a null id: never).
    A null text, or one without a letter, gets `und` with score 0, as does every text if there is nothing to learn from.
    Ties go to the first language by name, repeated rows get equal results, an empty table gives no rows, other columns
    are ignored. All labelled texts are learned from, whole.
    """
    require(docs, "doc_id", "text", "lang")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))
    rows = docs.select("doc_id", "text", "lang", out.alias("held_out"))
    labelled = rows.filter(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    names, protos = prototypes(labelled, dims, seed)
    return identify(rows, names, protos, dims, seed)
