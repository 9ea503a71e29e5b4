"""The text operators against plain versions, on odd rows: null, empty, very long, tied and repeated ones."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm.common import id_ranks
from gridloom.llm import components, jaccard, langid, mixing, packing, quality, sketch, suffix, tokens, transducer

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, block long, n long, size string, kept string, copies int"


def text(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def rows(seed=0, n=60):
    """Documents with copies, near copies and shared passages, and columns whose names operators use inside."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    shared = text(rng, words, 30)
    texts = [None, "", "   \n\t ", "a", "Ä ß 日本語 😀", "word " * 3000, "x" * 5000, shared, "same words here", "Same WORDS here"]
    while len(texts) < n:
        kind = rng.randrange(5)
        old = rng.choice([t for t in texts if t and len(t) > 200] or [shared])
        if kind == 0:
            texts.append(old)
        elif kind == 1:
            parts = old.split()
            parts[rng.randrange(len(parts))] = "edited"
            texts.append(" ".join(parts))
        elif kind == 2:
            texts.append(text(rng, words, 20) + " " + shared + " " + text(rng, words, 20))
        else:
            texts.append(text(rng, words, rng.randint(1, 300)))
    ids = rng.sample(range(10 * n), n)
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None]), 1, 2, "size", "kept", 3) for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, a repeated id and null ids."""
    return spark.createDataFrame([(1, "one two three four five six", None, None, 0, 0, "", "", 0)] * 2 + [(None, None, None, None, 0, 0, "", "", 0), (None, "one two three four five six", "en", "s", 0, 0, "", "", 0)], SCHEMA)


def test_token_counts(docs, odd, empty):
    library = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in tokens.token_counts(docs, PATH, 1024, 64).collect()}
    for i, t, *_ in rows():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 1024)
    assert tokens.token_counts(odd, PATH).count() == 4 and tokens.token_counts(empty, PATH).count() == 0


def test_pieces_of_other_libraries(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, path).collect()}
    assert got == {r[0]: len(library.encode(r[1] or "")) for r in rows()}


def test_other_tokenizers_take_texts_whole(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, path).collect()}
    assert got == {r[0]: len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows()}


def test_compiled_tokenizer_equals_the_library():
    rng, machine, library = random.Random(5), transducer.compiled(PATH), Tokenizer.from_file(PATH)
    alphabet = ["a", "b's", " ", "\n", " ", "  ", "\x1c", "1", "!", ",", "Zw.", "<|endoftext|>", "é", "日", "'", "'re", "'ll", "'v", "the", "ing", "aaaa", "\u3000", "👍🏽", "½", "ा", "\t", "’s", "İ", "\0"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(6000)] + ["x" * 20_000, "ab" * 9000 + "'s" * 500]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    counts, ids = machine.encode(texts, True)
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    for chunk in (1, 2, 7):
        assert machine.encode(texts[:800], chunk=chunk)[0].tolist() == counts[:800].tolist()
    for span in (3, 40):
        got = [(k, n.tolist(), i.tolist()) for k, n, i in tokens.encode_spans(texts[:500], PATH, True, span)]
        assert [c for _, n, _ in got for c in n] == counts[:500].tolist() and [i for *_, x in got for i in x] == [i for w in want[:500] for i in w]
    assert [k for k in range(8)] == transducer.compose((np.arange(8)[None], np.zeros((1, 8), int)), (np.arange(8)[None], np.zeros((1, 8), int)))[0][0].tolist()


def test_chunk_maps_compose_in_any_order():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 9, (12, 5)).astype(np.int8)
    whole = transducer.chunk_maps(rows.reshape(1, -1))
    scanned = transducer.prefix_scan(transducer.chunk_maps(rows))
    assert all((scanned[i][-1] == whole[i][0]).all() for i in (0, 1))


def test_a_full_table_is_compiled_anew(monkeypatch):
    machine = transducer.compiled(PATH)
    monkeypatch.setattr(transducer, "LIMIT", 10)
    want = [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(["some words here", "other ones"], add_special_tokens=False)]
    for _ in range(3):
        assert machine.encode(["some words here", "other ones"])[0].tolist() == want


def check_packing(result, texts, capacity):
    library = Tokenizer.from_file(PATH)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in result:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = 0
    for i, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    return len(sequences), -(-total // capacity)


def test_packing(docs, odd, empty):
    used, bound = check_packing(packing.pack(docs, PATH, 256).collect(), {r[0]: r[1] for r in rows()}, 256)
    assert used <= bound * 1.2
    assert packing.pack(empty, PATH).count() == 0
    assert Counter(r.doc_id for r in packing.pack(odd, PATH).collect()) == {1: 2, None: 2}


def test_bin_completion_is_optimal_on_small_cases():
    def fewest(sizes, room):
        best = [len(sizes)]

        def put(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + sizes[i] <= room:
                    put(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
            put(i + 1, [*bins, sizes[i]])

        put(0, [])
        return best[0]

    rng, proven = random.Random(2), 0
    for k in range(120):
        sizes = sorted((rng.randint(1 + 3 * (k % 2), 20) for _ in range(rng.randint(1, 10))), reverse=True)
        packed = packing.bin_completion(dict(Counter(sizes)), 20)
        assert sum(n for _, n in packed.plan) == packed.bins == fewest(sizes, 20) >= packed.bound and packed.proven
        assert sum((Counter({s: c * n for s, c in pattern}) for pattern, n in packed.plan), Counter()) == Counter(sizes)
        proven += packed.bins > packed.bound
    assert proven
    short = packing.bin_completion(dict(Counter(rng.randint(100, 400) for _ in range(500))), 1024, 5)
    assert short.bins >= short.bound and sum(n for _, n in short.plan) == short.bins


def test_mixing(spark, docs, odd, empty):
    got = mixing.mix(docs).collect()
    size = {i: len((t or "").encode().split()) for i, t, *_ in rows()}
    by, total = defaultdict(int), sum(size.values())
    for r in got:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"] and r.taken == r["size"] * r.copies
        by[r.source] += r["size"]
    targets = {r.source: r.target for r in got}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 * total
    level = [targets[s] / w for s, w in zip(sorted([s for s in by if s]) + [None], (5, 2, 1, 5), strict=True) if targets[s] < 2 * by[s] - 1e-9]
    assert all(t <= 2 * by[s] + 1e-9 for s, t in targets.items()) and max(level) - min(level) < 1e-6 * max(level)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(empty).count() == 0 and mixing.mix(odd).count() == 4
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})


def hashed(shingle):
    seed = 42
    for w in shingle:
        seed = xxhash.xxh64_intdigest(w.encode(), seed=seed)
    return seed >> 24


def plain_sketch(t):
    w = [x.decode() for x in t.encode().split()]
    found = {hashed(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {hashed([" ".join(w)])} if w else set()
    low = sorted(h for h in found if h < 2**40 // 8)
    return low if len(low) >= 16 else sorted(found)[:16]


def plain_bound(a):
    """Below it, a sketch has all hashes of its text."""
    return 2**40 if len(a) < 16 else max(a[-1] + 1, 2**40 // 8)


def plain_shares(a, b):
    """Likeness of two sketches, and containment of the first in the second."""
    below = min(plain_bound(a), plain_bound(b))
    x, y = ({h for h in s if h < below} for s in (a, b))
    return len(x & y) / len(x | y) if a or b else 1.0, 1.0 if not a else len(x & y) / len(x) if x else None


def test_fingerprints(docs, odd, empty):
    got = {r.doc_id: r for r in sketch.fingerprints(docs).collect()}
    ordered = sorted(rows())
    for k, (i, t, *_) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        a, b, c = map(plain_sketch, (t, edited, after))
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == "".join(f"{h:010x}" for h in a)
        for near, held, other in (("near_edited", "in_edited", b), ("near_next", "in_next", c)):
            likeness, share = plain_shares(a, other)
            assert abs(got[i][near] - likeness) < 1e-9
            assert got[i][held] is None if share is None else abs(got[i][held] - share) < 1e-9
    assert sketch.fingerprints(empty).count() == 0 and sketch.fingerprints(odd).count() == 4


def test_fingerprints_of_short_texts(spark):
    """Below LEAST shingles likeness is exact; beyond, an edited text is never without likeness, and a short text in a long one is unknown or right."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in [*range(1, 41), *range(60, 400, 20)] * 2]
    texts += [" ".join(rng.choice(words) for _ in range(3000))]
    texts += [" ".join(texts[-1].split()[k : k + 30]) for k in range(0, 600, 30)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} or {t}
    for r in sketch.fingerprints(frame).collect():
        t, after = texts[r.doc_id], texts[(r.doc_id + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        a, b = shingles(t), shingles(edited)
        if max(len(a), len(b)) < 16:
            assert abs(r.near_edited - len(a & b) / len(a | b)) < 1e-9
        assert r.near_edited > 0 or len(a) < 16
    whole = frame.filter("doc_id = %d" % texts.index(max(texts, key=len))).select(F.col("text").alias("whole"))
    parts = frame.filter(f"doc_id > {len(texts) - 21}").join(whole, F.expr("whole like concat('%', text, '%')"))
    held = parts.select(sketch.containment(sketch.sketch(F.col("text")), sketch.sketch(F.col("whole"))).alias("c")).collect()
    assert len(held) == 20 and {r.c for r in held} <= {None, 1.0} and any(r.c == 1.0 for r in held)


def test_fingerprints_across_buckets(spark):
    ids = [5, 1023, 1024, 9000, 9001]
    frame = spark.createDataFrame([(i, f"text number {i} " * 4) for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.edited_sha256 for r in sketch.fingerprints(frame).collect()}
    for k, i in enumerate(ids):
        t, after = f"text number {i} " * 4, f"text number {ids[(k + 1) % 5]} " * 4
        assert got[i] == hashlib.sha256((t[: len(t) - len(t) // 4] + after[: len(t) // 4]).encode()).hexdigest()


def test_sparse_and_missing_ids(spark):
    """Ids that are hashes, repeated or missing: next rows and ranks as in one sorted list."""
    rng = random.Random(11)
    data = [(rng.getrandbits(62) - 2**61, f"text {k} " * 3) for k in range(120)] + [(7, "same " * 5)] * 3 + [(None, f"none {k} " * 2) for k in range(20)]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = sketch.with_next(frame, "doc_id", "text", ["text"]).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(data)
    known = sorted((i, t) for i, t in data if i is not None)
    after = {(r.doc_id, r.text): r.next_text for r in got if (r.doc_id, r.text) != (7, "same " * 5)}
    assert all(after[a] == b[1] for a, b in zip(known, known[1:], strict=False) if a in after)
    assert sorted(r.next_text for r in got) == sorted(t for _, t in data)
    ranked = id_ranks(frame.withColumn("k", F.length("text") % 2), ["k"], ["doc_id", "text"], "rank").collect()
    for k in (0, 1):
        mine = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in ranked if r.k == k)
        assert [r[1:] for r in mine] == [(r.doc_id or 0, r.text) for r in sorted((r for r in ranked if r.k == k), key=lambda r: r.rank)]
        assert sorted(r.rank for r in ranked if r.k == k) == list(range(len(mine)))


def plain_classes(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent", "cell"), [(4, 85, 1 << 18), (5, 80, 300)])
def test_similarity_classes(docs, width, percent, cell):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(docs, width, percent, 4000, 500, cell).collect()}
    assert got == plain_classes({r[0]: r[1] for r in rows()}, width, percent)


def test_similarity_classes_of_a_large_group(spark):
    """Hundreds of near copies that are linked in a chain, in a group of several blocks."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    data = []
    for i in range(120):
        words[rng.randrange(60)] = f"v{i}"
        data.append((1000 - i, " ".join(words)))
    frame = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(frame, 4, 85, 3000, 500, 800).collect()}
    assert got == plain_classes(dict(data), 4, 85)


def test_rows_dealt_grow_with_a_group(spark):
    """Near copies of one text: what goes to cells is in proportion to their number, and the cells leave one component."""
    rng = random.Random(3)
    base, dealt = [rng.getrandbits(40) for _ in range(120)], []
    for n in (500, 1000, 2000):
        data = []
        for i in range(n):
            hashes = set(base) - set(rng.sample(base, 5)) | {rng.getrandbits(40) for _ in range(5 if i else 0)}
            data.append((i, len(hashes), sorted((n if h in base else 2, h) for h in hashes)))
        ordered = spark.createDataFrame([(i, m, [c for c, _ in e], [h for _, h in e]) for i, m, e in data], "rid long, n long, counts array<long>, hashes array<long>").cache()
        weights = ordered.select("rid", (F.size("hashes") + 16).alias("w"), jaccard.band(F.col("n"), 85).alias("band"))
        star = jaccard.stars(ordered, 85).cache()
        cells, sized = jaccard.star_cells(star, weights, 10_000)
        assert sized.filter("parts > 1").count() > 0
        sets = cells.withColumn("label", F.col("rid")).join(ordered, "rid").select("hub", "i", "j", "rid", "label", "n", "counts", "hashes")
        links = jaccard.links_of(sets.repartition(4, "hub", "i", "j").sortWithinPartitions("hub", "i", "j", "rid"), 85)
        labels = components.components(links).select(F.col("node").alias("rid"), "label")
        spread = star.unionByName(sized.select("hub", F.col("hub").alias("rid")))
        dealt.append(cells.count() + jaccard.cross_cells(spread, labels, weights, 10_000).count())
    assert dealt[2] <= 2.3 * dealt[1] <= 5.3 * dealt[0] and dealt[0] < 3 * 500


def test_similarity_classes_of_odd_tables(odd, empty):
    assert jaccard.similarity_classes(empty).count() == 0
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similarity_classes(odd).collect())
    assert got == {(1, 3, 1): 2, (None, 0, None): 1, (None, 3, 1): 1}


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 103: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_gone(texts, width):
    """Which bytes of each text a string that an earlier text has covers."""
    seen, out = set(), {}
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        gone = np.zeros(len(data) + width, bool)
        strings = [data[k : k + width] for k in range(len(data) - width + 1)]
        for k, s in enumerate(strings):
            if s in seen:
                gone[k : k + width] = True
        seen.update(strings)
        out[i] = data, gone[: len(data)].tolist()
    return out


def plain_cut(texts, width):
    out = {}
    for i, (data, gone) in plain_gone(texts, width).items():
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g))
    return out


def plain_joined(text, gone):
    """The characters that are not covered as wholes, with a space where a cut would join words."""
    out, at, cut = "", 0, False
    for ch in text:
        n = len(ch.encode())
        if all(gone[at : at + n]):
            cut = True
        else:
            if cut and out and not out[-1].isspace() and not ch.isspace():
                out += " "
            out, cut = out + ch, False
        at += n
    return out


@pytest.mark.parametrize("width", [50, 30])
def test_repeats(docs, width):
    out = suffix.remove_repeats(docs, width, 3000, 2000)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()}
    assert got == plain_cut({r[0]: r[1] for r in rows()}, width)


@pytest.mark.parametrize("width, crowd", [(50, 2), (50, 20), (30, 2), (51, 2)])
def test_repeats_around_crowded_anchors(spark, width, crowd):
    rng = random.Random(width + crowd)
    line = "this line stands in every text of them, "
    noise = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    texts = {i: noise(rng.randint(0, 70)) + line[rng.randint(0, 9) :] + noise(rng.choice((0, 3, 9))) + line + noise(rng.randint(0, 70)) for i in range(150)}
    shared = [noise(20) + line + noise(30) for _ in range(4)]
    texts |= {200 + i: noise(rng.randint(0, 9)) + rng.choice(shared)[rng.randint(0, 30) :] + noise(rng.randint(0, 9)) for i in range(60)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove_repeats(frame, width, 3000, 2000, crowd=crowd).collect()}
    assert got == plain_cut(texts, width) and sum(g[1] for g in got.values())


def test_groups_of_starts_meet_in_one_shard():
    rng = random.Random(8)
    core = bytes(rng.randrange(97, 123) for _ in range(80))
    for _ in range(300):
        left, right = (bytes(rng.randrange(97, 123) for _ in range(rng.randint(0, 40))) for _ in range(2))
        cut, stop = rng.randint(0, 30), rng.randint(50, 80)
        data = left + core[cut:stop] + right
        at = len(left) + 30 - cut  # the anchor's place in core is 30
        own = {(s, data[i : i + 50]) for s, start, end in suffix.split_starts(data, at, 97, 50) for i in range(start, end - 49)}
        whole = {(s, core[i : i + 50]) for s, start, end in suffix.split_starts(core, 30, 97, 50) for i in range(start, end - 49)}
        starts = range(max(0, at - 30), min(at, len(data) - 50) + 1)
        assert {t for _, t in own} == {data[i : i + 50] for i in starts}
        assert all((s, t) in own for s, t in whole if t in {t for _, t in own})


@pytest.mark.parametrize("width", [50, 30])
def test_a_start_is_sent_once(width):
    """To the shard of the first smallest gram of its string, and to no other."""
    rng = random.Random(width)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(600)), "ab" * 100, "a" * 90]
    asked = [suffix.ask_anchors(b, texts, np.ones(3, bool), np.arange(3) + 3 * b, 1, width) for b in (0, 1)]
    mail = suffix.answer_anchors(pa.concat_tables(asked))
    sent = suffix.send_strings(1, texts, np.arange(3) + 3, mail.filter(pc.equal(mail["block"], 1)), 1, width)
    starts = Counter()
    for kind, x, y in zip(*(sent.column(c).to_pylist() for c in ("kind", "x", "y")), strict=True):
        assert kind == 0
        lengths, counts = np.frombuffer(x, "<u4").reshape(2, -1)
        for (row, at), n in zip(np.frombuffer(y, suffix.PLACE).tolist(), np.repeat(lengths, counts).tolist(), strict=True):
            starts.update((row, at + k) for k in range(n - width + 1))
    assert starts == Counter((i, k) for i, t in enumerate(texts) for k in range(len(t) - width + 1))


def test_suffixes_told_apart_are_not_sorted_again(monkeypatch):
    from gridloom.llm import induced

    names = np.r_[np.random.default_rng(2).permutation(5000), np.tile([7, 7, 9], 20)]
    sizes, sort = [], np.argsort
    monkeypatch.setattr(induced.np, "argsort", lambda a, **how: sizes.append(len(a)) or sort(a, **how))
    got = induced.doubled(names, 10**9)
    assert got.tolist() == sorted(range(len(names)), key=lambda i: names[i:].tolist())
    assert len(sizes) > 3 and sum(sizes) < len(names) + 500


def test_repeats_of_odd_tables(spark, odd, empty):
    assert suffix.remove_repeats(empty).count() == 0 and suffix.remove_repeats(odd).count() == 4
    long = "abcdefghij" * 12
    frame = spark.createDataFrame([(1, long), (1, long), (None, long), (2, "aaaa" * 30), (3, "aaaa" * 40)], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_removed) for r in suffix.remove_repeats(frame).collect())
    assert got == {(1, 0): 2, (None, 120): 1, (2, 0): 1, (3, 160): 1}


def test_cuts_between_characters():
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice(["a", "ê", "日", "😀", " ", "\n"]) for _ in range(rng.randint(1, 60)))
        data, width = t.encode(), 5
        starts = sorted(rng.sample(range(max(1, len(data) - width)), k=min(3, max(1, len(data) - width))))
        if len(data) < width:
            continue
        gone = [any(s <= k < s + width for s in starts) for k in range(len(data))]
        out, removed, _ = suffix.cut(data, np.array(starts), np.ones(len(starts), np.uint32), width, b" ")
        assert out.decode() == plain_joined(t, gone) and removed == sum(gone)


def test_suffix_array_with_queues_on_disk():
    from gridloom.llm.induced import suffix_array

    rng = np.random.default_rng(1)
    for _ in range(80):
        keys = int(rng.integers(2, 6))
        t = np.r_[rng.integers(1, keys, rng.integers(1, 150)), 0].astype(np.int16)
        assert suffix_array(t, keys, 10**9, 64).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_languages(spark, odd, empty):
    rng = random.Random(4)
    alphabets = {"en": "the of and to in", "de": "der und die nicht ein", "fr": "le que des une pour"}
    data = [(i, text(rng, words.split(), 30), lang) for i in range(300) for lang, words in [rng.choice(list(alphabets.items()))]]
    data += [(300, None, "en"), (301, "123 !!!", "de"), (302, "", None)]
    got = {r.doc_id: r for r in langid.detect_languages(spark.createDataFrame(data, "doc_id long, text string, lang string"), 512).collect()}
    for i, t, lang in data:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1
        assert got[i].lang_pred == (lang if t and any(c.isalpha() for c in t) else "und")
    assert langid.detect_languages(empty).count() == 0
    assert {r.lang_pred for r in langid.detect_languages(odd.select("doc_id", "text", "lang")).collect()} <= {"und", "en"}


def test_languages_against_plain_vectors(spark):
    """Scores and predictions from vectors that are bound, bundled and compared one trigram at a time."""
    rng, dims = random.Random(14), 256
    data = [(i, text(rng, ["thé", "Of", "and", "x1y", "der", "日本"] if i % 2 else ["que", "des", "une!"], rng.randint(1, 12)), "ab"[i % 2]) for i in range(40)]
    letters = {}

    def vector(c):
        if c not in letters:
            letters[c] = 2 * np.random.default_rng([7, ord(c)]).integers(0, 2, dims, dtype=np.int8).astype(int) - 1
        return letters[c]

    def profile(t):
        s = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        grams = [s[k : k + 3] for k in range(len(s) - 2) if s[k + 1] != " "]
        return sum((np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c) for a, b, c in grams), np.zeros(dims))

    out = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in data}
    protos = {lang: sum(profile(t) for i, t, x in data if x == lang and not out[i]) for lang in "ab"}
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string")
    for r in langid.detect_languages(frame, dims).collect():
        p = profile(data[r.doc_id][1])
        cosine = {lang: float(p @ v / np.linalg.norm(p) / np.linalg.norm(v)) for lang, v in protos.items()}
        assert r.held_out == out[r.doc_id] and abs(r.score - max(0, cosine[r.lang_pred])) < 1e-4 and cosine[r.lang_pred] > max(cosine.values()) - 1e-4


def units(t):
    """Code points up to U+0BFF as they are, the others as a lead and their low eleven bits."""
    return [u for c in map(ord, t) for u in ([c] if c < 0xC00 else [0xC00 + (c >> 11), c & 0x7FF])]


def plain_model(texts, order):
    """Modified Kneser-Ney over characters, with dictionaries."""
    pad = (quality.PAD,) * (order - 1)
    grams = {order: Counter()}
    for t in texts:
        s = (*pad, *units(t))
        grams[order].update(s[i : i + order] for i in range(len(s) - order + 1))
    for n in range(order - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    discount = {}
    for n, c in grams.items():
        many = Counter(c.values())
        y = many[1] / (many[1] + 2 * many[2]) if many[1] + 2 * many[2] else 0.5
        discount[n] = [min(max(k - (k + 1) * y * many[k + 1] / many[k], quality.LEAST_DISCOUNT), k) if many[k] else 0.5 for k in (1, 2, 3)]
    context = {n: defaultdict(list) for n in grams}
    for n, c in grams.items():
        for g, k in c.items():
            context[n][g[:-1]].append(k)
    symbols = len(grams[1]) + 1

    def p(g):
        n = len(g)
        lower = p(g[1:]) if n > 1 else 1 / symbols
        if not (counts := context[n].get(g[:-1])):
            return lower
        d = discount[n]
        back = sum(min(d[min(k, 3) - 1], k) for k in counts)
        c = grams[n].get(g, 0)
        return (max(c - d[min(c, 3) - 1], 0) * (c > 0) + back * lower) / sum(counts)

    def perplexity(t):
        s = (*pad, *units(t))
        return float(np.exp(-np.mean([np.log(p(s[i : i + order])) for i in range(len(s) - order + 1)])))

    return perplexity


def test_perplexity(spark):
    rng = random.Random(8)
    train = [text(rng, ["the", "of", "cat", "dog", "Ärger", "日"], 12) for _ in range(20)]
    probe = ["the cat of dog", "zzz ??? 123", "日 Ärger", "t", None, ""] + train[:3]
    model = quality.Model(quality.ngram_counts(spark.createDataFrame([(t,) for t in train], "text string"), 3), 3)
    frame = spark.createDataFrame(list(enumerate(probe)), "doc_id long, text string")
    got = {r.doc_id: r.perplexity for r in quality.perplexities(frame, model, 20).collect()}
    plain = plain_model(train, 3)
    for i, t in enumerate(probe):
        assert (got[i] is None) if not t else abs(got[i] / plain(t) - 1) < 1e-5


def joins(df):
    """How many joins a frame's plan holds."""
    return len(re.findall(r"\bJoin ", df._jdf.queryExecution().optimizedPlan().toString()))


def test_plans_hold_the_joins_of_one_order(spark):
    """A plan of all orders' joins takes the driver's memory; each lower order is read from a table."""
    texts = spark.createDataFrame([("the cat and the dog",), ("a dog on a mat",)], "text string")
    wanted = quality.ngram_counts(texts, 5).select("code")
    found = [quality.Model(quality.ngram_counts(texts, n), n).probabilities(wanted, n) for n in (2, 5)]
    assert joins(found[0]) == joins(found[1]) == 3


def test_plans_read_the_members_of_stars_from_a_table(spark):
    """What joins stars, labels and weights stands once in a plan that reads it four times."""
    star = spark.createDataFrame([(h, r) for h in (0, 7) for r in range(8)], "hub long, rid long")
    labels = spark.createDataFrame([(r, r // 4) for r in range(8)], "rid long, label long")
    weights = spark.createDataFrame([(r, 10 + r, r // 6) for r in range(8)], "rid long, w long, band int")
    cells = jaccard.cross_cells(star, labels, weights, 20)
    assert joins(cells) == 3
    met = Counter((r.hub, r.i, r.j) for r in cells.collect())
    assert met and {k[0] for k in met} == {0, 7}


def plain_repeats(t):
    """Words of a text, and those that equal the first, else the second, word before them."""
    words = re.findall(r"[^\s\u3000]+", t)
    near = [next((d for d in range(1, quality.REACH + 1) if k >= d and words[k - d] == w), 0) for k, w in enumerate(words)]
    return len(words), [near.count(d) for d in range(1, quality.REACH + 1)]


def test_repeated_words_are_counted():
    rng = random.Random(6)
    texts = ["", "a", "a a", " a  a\n\ta", "ab ab ba ab", "a", "a", "x y x y x", " "] + [" ".join(rng.choice(["aa", "ab", "ba", "é"]) for _ in range(rng.randint(0, 9))) for _ in range(200)]
    words, near = quality.repeated(texts)
    assert list(zip(words.tolist(), near.tolist(), strict=True)) == [plain_repeats(t) for t in texts]
    assert quality.repeated(["", ""])[0].tolist() == [0, 0]


def test_repeated_words_are_rejected(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinsh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    clean = [(i, text(rng, words, rng.randint(20, 60)), "en") for i in range(200)]
    junk = [(1000 + i, " ".join([w] * 30), "en") for i, w in enumerate(words[:20])] + [(1100 + i, " ".join(words[i : i + 2] * 20), "en") for i in range(20)]
    frame = spark.createDataFrame([*clean, *junk], "doc_id long, text string, lang string")
    got = {r.doc_id: r.keep for r in quality.classify(frame, spark.createDataFrame([(i,) for i in range(120)], "doc_id long")).collect()}
    assert all(got[i] for i in range(120)) and not any(got[i] for i, *_ in junk)


def test_quality(spark, odd, empty):
    rng = random.Random(3)
    clean = [(i, text(rng, "the cat sat on a mat and saw its dog".split(), rng.randint(5, 60)), "en") for i in range(200)]
    junk = [(1000 + i, text(rng, ["QX!!", "%%%", "|", "ZZZ###"], 40), "en") for i in range(20)]
    frame = spark.createDataFrame([*clean, *junk, (2000, None, "en"), (2001, "", None)], "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in [*range(120), 120, 120, 99999]] + [(None,)], "doc_id long")
    got = {r.doc_id: r.keep for r in quality.classify(frame, trusted, 4).collect()}
    assert all(got[i] for i, *_ in clean) and not any(got[i] for i, *_ in junk) and not got[2000] and not got[2001]
    assert quality.classify(empty, trusted).count() == 0
    assert Counter(r.keep for r in quality.classify(odd, trusted.limit(0)).collect()) == {True: 3, False: 1}
