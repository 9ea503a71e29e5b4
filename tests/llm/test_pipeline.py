"""The pipeline against the same stages written plainly, on generated documents with junk, copies and shared passages."""

import hashlib
import math
import random
import struct
import sys
import zlib
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline
from gridloom.llm.common import WRITTEN, materialize, sweep
from test_documents import plain_classes, plain_gone, plain_joined, plain_model, text


def documents():
    rng = random.Random(12)
    words = ["".join(rng.choice("etaoinsh") for _ in range(rng.randint(2, 7))) for _ in range(120)]
    passage = text(rng, words, 30)
    rows = []
    for i in range(150):
        kind = i % 10
        t = text(rng, words, rng.randint(20, 90))
        old = [r[1] for r in rows if r[0] % 10 != 6]
        if kind == 3:
            t = rng.choice(old)
        elif kind == 4:
            t = rng.choice(old) + " " + rng.choice(words)
        elif kind == 5:
            t = t + " " + passage + " " + text(rng, words, 40)
        elif kind == 6:
            t = text(rng, ["QX!!", "%%%", "|", "ZZ###"], 40)
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
    return [*rows, (150, None, "en", "s0", 0), (151, "", None, None, 0)]


def plain_pipeline(rows, trusted):
    fold = lambda i: (xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42) ^ (1 << 63)) - (1 << 63)
    learn = [i for i in sorted(trusted) if fold(i) % 5]
    probe = plain_model([rows[i][1] for i in learn], 5)
    score = {i: probe(r[1]) for i, r in rows.items() if r[1]}
    even = sorted(score[i] / math.exp(1 / math.sqrt(len(rows[i][1]))) for i in trusted if fold(i) % 5 == 0)
    limit = even[math.ceil(0.99 * len(even)) - 1] * 1.12
    kept = {i: rows[i][1] for i, s in score.items() if s <= limit * math.exp(1 / math.sqrt(len(rows[i][1])))}
    classes = plain_classes(kept, 5, 80)
    kept = {i: t for i, t in kept.items() if classes[i][1] == i}
    cut = plain_gone(kept, 50)
    kept = {i: plain_joined(kept[i], gone) for i, (data, gone) in cut.items() if not all(gone)}
    kept = {i: t for i, t in kept.items() if t.strip() or not any(cut[i][1])}
    size = {i: len(t.split()) for i, t in kept.items()}
    by = defaultdict(list)
    for i in kept:
        by[rows[i][3]].append(i)
    totals = {s: sum(size[i] for i in ids) for s, ids in by.items()}
    weight = dict(zip(sorted(totals), (5, 2, 1), strict=True))
    target, open_, left = {}, set(totals), 1.5 * sum(totals.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * totals[s]}
        if not full:
            target.update({s: level * weight[s] for s in open_})
            break
        target.update({s: 2.0 * totals[s] for s in full})
        left -= sum(2.0 * totals[s] for s in full)
        open_ -= full
    copies = {}
    for s, ids in by.items():
        rate, start = target[s] / totals[s], int(hashlib.md5(f"mix:{s}".encode()).hexdigest()[:4], 16) / 65536
        for k, i in enumerate(sorted(ids, key=lambda i: (size[i], i))):
            copies[i] = math.floor((k + 1) * rate + start) - math.floor(k * rate + start)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = Counter()
    for i, n in copies.items():
        ids = library.encode(kept[i], add_special_tokens=False).ids + [2]
        stops = [*range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        for k, (a, b) in enumerate(zip([0, *stops[:-1]], stops, strict=True)):
            pieces[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += n
    return +pieces, set(score) - set(kept)


def test_pipeline(spark, tmp_path):
    rows = documents()
    trusted = {r[0] for r in rows[:90] if r[0] % 10 != 6}
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i in trusted), 0) for i in range(100)] + [(100, 1, 1), (9999, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    trusted.add(9999)
    want, gone = plain_pipeline({r[0]: r for r in rows}, trusted - {9999})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert gone and {i for i in gone if rows[i][0] % 10 == 6} == {r[0] for r in rows if r[0] % 10 == 6 and r[1]}
    at = defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "mixing sources", "best-fit packing"]


def test_tables_of_two_runs(spark):
    """A run in one thread leaves the tables of a run in another alone."""
    here = materialize(spark.range(3), "here")

    def other():
        kept = materialize(spark.range(5), "kept")
        since = len(WRITTEN)
        gone = materialize(spark.range(7), "gone")
        sweep(spark, since)
        return kept.count(), gone.inputFiles()[0].removeprefix("file://"), since

    with ThreadPoolExecutor(1) as pool:
        n, gone, since = pool.submit(other).result()
    assert (n, since) == (5, 1) and not Path(gone).exists() and here.count() == 3


def test_stages_on_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = empty
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == empty.columns and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Repeated rows, repeated and missing ids, other scripts, a very long text and columns that operators use inside."""
    rng = random.Random(2)
    words = ["".join(rng.choice("aêіящλ日本語") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    shared = text(rng, words, 25)
    long = text(rng, words, 30_000)
    a, b = text(rng, words, 60), text(rng, words, 60)
    rows = [(1, a), (1, a), (None, b), (None, b), (2, b), (3, long), (4, text(rng, words, 20) + shared + text(rng, words, 20)), (5, text(rng, words, 20) + "x" + shared + "y" + text(rng, words, 20)), (6, None), (None, ""), (7, "y " + a[1:])]
    names = "doc_id long, text string, lang string, source string, n_chars int, kept string, key string, n_removed long, block int, c0 string, size int, copies string, component_id long"
    frame = spark.createDataFrame([(i, t, "xx", None, len(t or ""), f"KEEP{k}", "k", 7, 8, "c", 9, "n", 10) for k, (i, t) in enumerate(rows)], names)
    spark.createDataFrame([(i, 1, 0) for i in range(1, 8)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    tags = lambda df: sorted(int(r.kept[4:]) for r in df.collect())
    judged = stages["quality classifier"](spark, frame, str(tmp_path))
    assert judged.schema == frame.schema and not {8, 9} & set(tags(judged)) and {0, 1, 4, 5} <= set(tags(judged))
    single = stages["n-gram Jaccard join"](spark, frame, str(tmp_path))
    assert single.schema == frame.schema and tags(single) in ([0, 4, 5, 6, 7, 8, 9], [1, 4, 5, 6, 7, 8, 9])
    cut = stages["suffix-array dedup"](spark, frame, str(tmp_path))
    assert cut.schema == frame.schema
    got = {int(r.kept[4:]): r for r in cut.collect()}
    assert {0, 1, 4, 5, 6, 7, 8, 9} <= set(got) and not {2, 3} & set(got) and (got[8].text, got[9].text) == (None, "")
    assert all("\ufffd" not in (r.text or "") and r.n_chars == len(r.text or "") and (r.key, r.n_removed, r.c0) == ("k", 7, "c") for r in got.values())
    assert "x y" in got[7].text and shared in got[6].text
    mixed = stages["mixing sources"](spark, frame, str(tmp_path))
    assert mixed.schema == frame.schema
    taken, size = Counter(tags(mixed)), [len((t or "").split()) for _, t in rows]
    assert max(taken.values()) <= 2 and abs(sum(size[k] * n for k, n in taken.items()) - 1.5 * sum(size)) <= max(size)
    packed = stages["best-fit packing"](spark, frame, str(tmp_path)).collect()
    assert sum(r.piece == 0 for r in packed) == len(rows)
