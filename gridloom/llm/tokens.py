"""Token counts with a compiled tokenizer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm.common import batch, require, tidy
from gridloom.llm.transducer import compiled

#: Code points that are taken at a time.
SPAN = 1 << 20
#: No pre-token goes on from a character that is no white space to one that is.
SEAM = re.compile(r"(?<=\S)[ \t\n]")


@lru_cache(maxsize=4)
def library(path: str):
    """texts -> ids of each, with the library of a tokenizer file that isn't compiled."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).encode
    found = Tokenizer.from_file(path)
    return lambda texts: [e.ids for e in found.encode_batch(texts, add_special_tokens=False)]


def encode(texts: list[str], path: str, ids: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Tokens of each text, and the ids of all, if asked for."""
    if machine := compiled(path):
        return machine.encode(texts, ids)
    found = library(path)(texts)
    return np.array([len(x) for x in found], dtype=np.int64), np.array([i for x in found for i in x], dtype=np.int64) if ids else None


def windows(text: str, span: int) -> Iterator[str]:
    """A long text cut where no pre-token is, into parts of about so many code points."""
    at = 0
    while len(text) - at > span:
        seam = SEAM.search(text, at + span)
        if not seam:
            break
        yield text[at : seam.start()]
        at = seam.start()
    yield text[at:]


def encode_spans(texts: list[str], path: str, ids: bool = False, span: int = SPAN) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """first text, counts, ids, for runs of texts of about so many code points; a longer text comes alone, read in windows."""
    start = size = 0
    for k, t in enumerate([*texts, None]):
        if t is None or start < k and size + len(t) > span:
            if start < k:
                yield start, *encode(texts[start:k], path, ids)
            start, size = k, 0
        if t is None:
            break
        if len(t) > span and compiled(path):
            parts = [encode([w], path, ids) for w in windows(t, span)]
            yield k, np.array([sum(int(n[0]) for n, _ in parts)]), np.concatenate([i for _, i in parts]) if ids else None
            start = k + 1
        else:
            size += len(t)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, span: int = SPAN) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs(doc_id, text); tokenizer: path of a .json or .model file.

    A byte-level BPE is compiled to transducers; other files are read with their library. A null text counts as empty: no bytes,
    no tokens. Repeated rows give repeated results, a null doc_id stays null, an
    empty table gives no rows, and other columns are ignored. Texts of any length are counted whole. Nothing is shuffled.
    """
    require(docs, "doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [x or "" for x in rows.column(1).to_pylist()]
            n = np.zeros(len(texts), np.int64)
            for start, counts, _ in encode_spans(texts, tokenizer, False, span):
                n[start : start + len(counts)] = counts
            yield tidy(batch(schema, doc_id=rows.column(0), n_bytes=rows.column(2), n_tokens=n, over_limit=n > limit))

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return docs.select(F.col("doc_id").cast("long"), "text", size).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
