"""Alignment of tokenizers, lattice hashing and resampling against plain versions, on odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gridloom.llm import align, lattice, resample

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CLASH = "key long, group string, v long, m int, id long, block int, part string, at int, n long, sid long, tokens string, bucket int, text2 string, score long"
EXTRA = (1, "g", 2, 3, 4, 5, "p", 6, 7, 8, "t", 9, "x", 10)


def plain_alignment(rows):
    """Each text whole, with loops; rows without an id are told by their place."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = align.byte_level()
    seen, count = [], Counter()

    def spans(spelled):
        ends = np.cumsum([0, *map(len, spelled)]).tolist()
        return list(zip(ends[:-1], ends[1:], strict=True))

    for _, t in rows:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        p = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        q = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not t or b"".join(p) != (" " + t).encode() or b"".join(q) != (" " + t).encode():
            seen.append(([], [], [], []))
            continue
        p, q = spans(p), spans(q)
        links = [(i, j) for k, i in enumerate(x) for m, j in enumerate(y) if p[k][0] < q[m][1] and q[m][0] < p[k][1]]
        count.update(links)
        seen.append((list(zip(x, p, strict=True)), list(zip(y, q, strict=True)), sorted({e for _, e in p} & {e for _, e in q}), links))
    best = Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = []
    for (doc_id, _), (x, y, cuts, links) in zip(rows, seen, strict=True):
        groups = [",".join(str(i) for i, (_, e) in x if s < e <= c) + "|" + ",".join(str(i) for i, (_, e) in y if s < e <= c) for s, c in zip([0, *cuts], cuts, strict=False)]
        out.append((doc_id, len(x), len(y), len(cuts), len(links), sum(count[k] == best[k[1]] for k in links), sum(count[k] for k in links), ";".join(groups)))
    return sorted(out, key=repr)


TEXTS = [
    None, "", " ", "a", "The quick brown fox jumps over the lazy dog.", "The quick brown fox jumps over the lazy dog.", "  two  spaces \n and\n lines\t \ttabs ", "Ä ß 日本語テキスト 😀👩‍👩‍👧 ﬁ Ａ",
    "a ▁ sign of pieces", "under▁score and words", "<s> </s> <|endoftext|> <unk> <0x41>", "x" * 700, "it's they're 12345 1,000.50 --- ###", "no break   space   wide", "\x1c odd \x1f marks \x00 nul", "unhappily tokenization disagreements", "é combining", " leading and trailing ",
]


@pytest.mark.parametrize("span", [1 << 24, 40])
def test_alignment(spark, span):
    rng = random.Random(3)
    words = [w for t in TEXTS if t for w in t.split(" ")] + ["", "\n", "▁", "naïve", "Straße"]
    texts = TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(40)]
    rows = [(None if i == 5 else i % 50, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(*r, *EXTRA) for r in rows], f"doc_id long, text string, {CLASH}").repartition(3)
    got = sorted((tuple(r) for r in align.align(frame, A, B, span=span).collect()), key=repr)
    assert got == plain_alignment(rows)
    assert spark.conf.get("spark.sql.parquet.compression.codec") == "snappy"


def test_alignment_of_long_texts_and_empty_tables(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("ab") for _ in range(3000)) + " " + " ".join(rng.choice(["alpha", "beta", "gammadelta"]) for _ in range(20_000))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = align.align(frame, A, B).first()
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    assert (row["n_a"], row["n_b"]) == (len(a.encode(" " + text).ids), len(b.encode(text)))
    ids = [g.split("|") for g in row["groups"].split(";")]
    assert [int(i) for g in ids for i in g[0].split(",")] == a.encode(" " + text).ids and [int(i) for g in ids for i in g[1].split(",")] == b.encode(text)
    assert align.align(frame.limit(0), A, B).count() == 0
    with pytest.raises(ValueError, match="columns missing"):
        align.align(frame.drop("text"), A, B)


def test_parts_are_spelled_as_whole_texts_are():
    rng = random.Random(9)
    a, b = align.side(A), align.side(B)
    assert a.seams and b.seams
    for _ in range(400):
        text = "".join(rng.choice(" \n\t ▁abcé日.,'s12<>") for _ in range(rng.randint(1, 30)))
        numbers = align.Numbers()
        parts = [list(numbers)[i] for i in align.cut(text, True, numbers)]
        assert " " + " ".join(parts) == " " + text
        for s in (a, b):
            assert [i for x in s.encode(parts) for i in x] == s.encode([text])[0]


def test_tokens_are_dealt_once(spark):
    rows = spark.createDataFrame([("x", 1, [1, 2], [3])], "part string, n long, a array<int>, b array<int>")
    sizes = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 3, 3)], "side int, id int, len int")
    out = align.token_links(rows, sizes)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("REPARTITION_BY_NUM") == 1 and plan.count("Sort [") == 2
    links = [tuple(r) for r in out.select("end", "a_own", "b_own", "gid", "a", "b").collect()]
    assert links == [(3, 2, 3, 1, 2, 3), (1, 1, None, 1, 1, 3)]
    assert [r.asDict() for r in align.by_part(out).collect()] == [{"part": "x", "n": 1, "n_a": 2, "n_b": 1, "groups": 1, "text": "1,2|3", "a": [2, 1], "b": [3, 3]}]


def plain_near(rows, least=0.93):
    ok = [i for i, (k, v, g) in enumerate(rows) if k is not None and g is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            a, b = (np.array(rows[x][1], float) / max(map(abs, rows[x][1])) for x in (i, j))
            if i != j and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= least:
                links[i].add(j)
    out = []
    for i, (k, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        top = k if k is None else min(rows[j][0] for j in seen)
        out.append((k, len(links[i]), top, None if k is None else top == k))
    return sorted(out, key=repr)


def vectors(seed=1, n=300, dims=24):
    rng = np.random.default_rng(seed)
    rows, centres = [], rng.normal(size=(12, dims))
    for i in range(n):
        v = centres[rng.integers(12)] + rng.normal(size=dims) * rng.choice([0.05, 0.15, 2.0])
        rows.append((i, v.tolist(), int(rng.integers(2))))
    rows += [(n + k, (np.array(rows[k][1]) * 4).tolist(), rows[k][2]) for k in range(10)]
    rows += [(n + 20 + k, rows[7][1], rows[7][2]) for k in range(30)]
    odd = [None, [], [0.0] * dims, [None, *[1.0] * (dims - 1)], [float("nan")] * dims, [float("inf")] * dims, [1.0, 2.0], [1.0, 2.1], [1e300] * dims, [1e-300] * dims, [2.0], [-3.0], [-0.0, 5.0], [0.0, 5.0]]
    rows += [(900 + k, v, 1) for k, v in enumerate(odd)]
    return [*rows, (None, rows[0][1], rows[0][2]), (950, rows[0][1], None), (-5, rows[1][1], rows[1][2]), (3, rows[3][1], rows[3][2]), (3, rows[4][1], rows[4][2])]


@pytest.mark.parametrize("block", [2048, 16])
def test_near_vectors(spark, block):
    rows = vectors()
    frame = spark.createDataFrame([(*r, *EXTRA) for r in rows], f"vec_id long, embedding array<double>, label int, {CLASH}").repartition(3)
    got = sorted((tuple(r) for r in lattice.near_vectors(frame, block=block).collect()), key=repr)
    assert got == plain_near(rows)
    assert lattice.near_vectors(frame.limit(0)).count() == 0


def test_cells_are_of_the_lattice():
    rng = np.random.default_rng(2)
    near = lattice.neighbours()
    assert len(near) == 240 and set((near**2).sum(1)) == {8} and len(set(map(tuple, near))) == 240
    x = rng.uniform(-3, 3, size=(500, 8))
    point = lattice.decode(x)
    assert (point.sum(1) % 4 == 0).all() and ((point % 2 == point[:, :1] % 2).all(1)).all()
    # No neighbour is nearer, and the lattice covers space with radius 1.
    gap = ((x - point / 2) ** 2).sum(1)
    assert gap.max() <= 1 + 1e-9 and all(((x - (point + v) / 2) ** 2).sum(1).min() >= 0 and (((x - (point + v) / 2) ** 2).sum(1) >= gap - 1e-9).all() for v in near)
    units = lattice.unit_rows(rng.normal(size=(50, 64)).ravel(), 64)
    alone = np.concatenate([lattice.cells(u[None], 4, 2, 2.0) for u in units])
    assert (alone == lattice.cells(units, 4, 2, 2.0)).all()


@pytest.mark.parametrize("dims", [8, 24, 64, 768])
def test_recall_at_the_threshold(dims):
    rng = np.random.default_rng(8)
    a = lattice.unit_rows(rng.normal(size=(2000, dims)).ravel(), dims)
    other = rng.normal(size=a.shape)
    other -= (other * a).sum(1, keepdims=True) * a
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * other
    x, y = (lattice.cells(v, lattice.TABLES, lattice.PROBES, lattice.SCALE) for v in (a, b))
    found = ((x == y[:, :, :1]) | (y == x[:, :, :1])).any((1, 2))
    assert found.mean() > 0.98


def plain_resample(docs, target, buckets=resample.BUCKETS, least=20, percent=10, orders=1):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in (t or "").translate(lower)).split(" ")
    words_of = lambda t: [w for w in words(t) if w]
    found = lambda t: [" ".join(w[i : i + n]) for w in [words_of(t)] for n in range(1, orders + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in rows for f in found(x)) for rows in ([d[1] for d in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    out = []
    for d, x in docs:
        h = int(hashlib.sha256(f"2024:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found(x))
        out.append([d, len(found(x)), len(words_of(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0))), None])
    drawn = sorted((r for r in out if r[2] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(drawn[: len(drawn) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("orders", [1, 3])
def test_resample(spark, orders):
    rng = random.Random(6)
    words = ["Alpha", "beta", "ÉTÉ", "日本", "x1", "ZZ", "don't", "a_b", "", " "] + ["w%d" % i for i in range(60)]
    texts = [None, "", " \n\x00", "one", *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(150)), "word " * 30_000]
    docs = [(i * 3, t) for i, t in enumerate(texts)] + [(None, texts[20]), (9, texts[21]), (9, texts[22])]
    target = [None, "", "alpha beta w1 w2 w3", "été 日本 w4"]
    frame = spark.createDataFrame([(*d, *EXTRA) for d in docs], f"doc_id long, text string, {CLASH}".replace("score long", "rank long")).repartition(4)
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    got = sorted((tuple(r) for r in resample.resample(frame, goal, orders=orders, buckets=500).collect()), key=repr)
    assert got == plain_resample(docs, target, 500, orders=orders)
    none = resample.resample(frame.limit(0), goal)
    assert none.count() == 0
    free = sorted((tuple(r) for r in resample.resample(frame, goal.limit(0)).collect()), key=repr)
    assert free == plain_resample(docs, [])


def test_resample_keeps_rows_where_they_were_read(spark):
    """One row per document, and the counts of buckets, are all that is shuffled; gains are broadcast."""
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    rows = docs.select("doc_id", resample.words(docs["text"]).alias("tokens"))
    plan = resample.bucket_counts(rows, 1, 100, "s")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(bucket") == 1 and "partial_count" in plan
