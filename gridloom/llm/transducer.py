"""A byte-level BPE tokenizer compiled to finite-state transducers.

The pre-tokenizer is a deterministic automaton of eight states over classes of characters (with the next two characters as
lookahead), whose transitions tell whether a pre-token starts. Text is cut into chunks; a chunk's map gives, for every state before it, the state after it
and the pre-tokens started in it. Maps compose associatively, so a prefix scan over all chunks yields the state before each.

Merges are an automaton over bytes. A state knows, for every place at which a token may still start, the last token before that
place and how many tokens there are before it, relative to here; a transition carries the change in the number of tokens. BPE is local: tokens
are the encoding of their bytes if and only if each two neighbours are, so of all tokens that end at a byte exactly one fits
the token before it. States and transitions are compiled when first met, from the file's merges alone, and kept in an
open-addressing table that whole arrays of lanes read at once.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

#: Symbols: letter, number, other, white space within a run, last of a run, plain space before a word, apostrophe of 's 't 'm 'd, of 're 've 'll, end of text.
L, N, O, W, LAST, JOIN, SHORT, LONG, END = range(9)
#: States: between pre-tokens, in a run of letters, numbers, others or white space, after a joining space, one and two characters before a contraction's end.
NONE, IN_L, IN_N, IN_O, IN_W, JOINED, ONE, TWO = range(8)
CHUNK, LANES, FEW = 256, 4096, 12
#: Transitions kept at most; a full table is compiled anew.
LIMIT = 1_000_000
NOWHERE = np.iinfo(np.int64).max


def byte_symbols() -> dict[int, str]:
    """Byte-level tokenizers write a printable Latin-1 byte as itself, the others as U+0100 onward in turn."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(others)}


def pre_tokenizer() -> tuple[np.ndarray, np.ndarray]:
    """next state and whether a pre-token starts, by state and symbol."""
    fresh = {L: IN_L, N: IN_N, O: IN_O, W: IN_W, LAST: NONE, JOIN: JOINED, SHORT: ONE, LONG: TWO, END: NONE}
    to = np.array([[fresh[s] for s in range(9)]] * 8)
    starts = np.ones((8, 9), dtype=bool)
    stay = [(IN_L, L, IN_L), (IN_N, N, IN_N), (IN_W, W, IN_W), (JOINED, L, IN_L), (JOINED, N, IN_N)]
    stay += [(state, s, IN_O) for state in (IN_O, JOINED) for s in (O, SHORT, LONG)]
    stay += [(ONE, s, NONE) for s in range(8)] + [(TWO, s, ONE) for s in range(8)]
    for state, s, then in stay:
        to[state, s], starts[state, s] = then, False
    return to, starts


TO, STARTS = pre_tokenizer()
MOVES = (TO + 8 * STARTS).astype(np.int32).ravel()


def chunk_maps(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """chunks x states: the state after each chunk (a row of symbols) and the pre-tokens started in it."""
    both = np.tile(np.arange(8, dtype=np.int32), (len(symbols), 1))
    turned = np.ascontiguousarray(symbols.T).astype(np.int32)
    for k in range(len(turned)):
        both = (both & ~7) + MOVES[(both & 7) * 9 + turned[k][:, None]]
    return both & 7, both >> 3


def compose(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The maps of chunks that follow each other, as one."""
    return np.take_along_axis(then[0], first[0], 1), first[1] + np.take_along_axis(then[1], first[0], 1)


def prefix_scan(maps: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each chunk's map composed with all before it, in a logarithmic number of steps over whole arrays."""
    state, count = maps
    step = 1
    while step < len(state):
        ahead = compose((state[:-step], count[:-step]), (state[step:], count[step:]))
        state, count = np.concatenate([state[:step], ahead[0]]), np.concatenate([count[:step], ahead[1]])
        step *= 2
    return state, count


def token_starts(symbols: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """True where a pre-token starts."""
    n = len(symbols)
    padded = np.full(-(-n // chunk) * chunk, END, dtype=np.int8)
    padded[:n] = symbols
    rows = padded.reshape(-1, chunk)
    after, _ = prefix_scan(chunk_maps(rows))
    state = np.r_[NONE, after[:-1, NONE]].astype(np.int32)
    turned = np.ascontiguousarray(rows.T).astype(np.int32)
    out = np.empty(turned.shape, dtype=bool)
    for k in range(chunk):
        move = MOVES[state * 9 + turned[k]]
        out[k] = move > 7
        state = move & 7
    return np.ascontiguousarray(out.T).ravel()[:n]


class Merges:
    """The merge automaton. State 0 is the start of a pre-token."""

    def __init__(self, vocab: dict[str, int], merges: list):
        back = {c: b for b, c in byte_symbols().items()}
        raw = {t: bytes(map(back.__getitem__, t)) for t in vocab if all(c in back for c in t)}
        self.tokens = {b: vocab[t] for t, b in raw.items()}
        self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)
        for b, i in self.tokens.items():
            self.lengths[i] = len(b)
        self.rank = dict.fromkeys(self.tokens.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.sound = all(bytes([b]) in self.tokens for b in range(256))
        for k, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            self.sound &= made not in self.parts and self.rank[x] < k and self.rank[y] < k
            self.parts[made], self.rank[made], self.pairs[x, y] = (x, y), k, k
        self.sound &= all(len(b) == 1 or i in self.parts for b, i in self.tokens.items())
        self.prefixes = {b[:k] for b in self.tokens for k in range(1, len(b))}
        self.kept: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        start = (b"", ((0, -1, 0),))
        self.states, self.names = [start], {start: 0}
        self.near: dict[int, bool] = {}
        self.items: dict[tuple[int, int, int], tuple[int, int, int]] = {}
        self.used = 0
        self.size = 1 << 16
        self.keys = np.full(self.size, -1, np.int64)
        self.moves = np.zeros(self.size, np.int64)
        self.last = np.full(1 << 12, -1, np.int64)

    def apart(self, a: int, b: int) -> bool:
        """Whether two tokens stay two when their bytes are encoded together.

        Going back in time, the later of the two merges beside the seam is undone; a merge across the seam that comes before
        the one undone would have joined them. Of equal merges the left one comes first.
        """
        if (known := self.near.get(a << 32 | b)) is not None:
            return known
        x, y, before, out = a, b, len(self.pairs), True
        while True:
            if self.pairs.get((x, y), before) < before:
                out = False
                break
            left, right = self.rank[x], self.rank[y]
            if left < 0 and right < 0:
                break
            if left > right:
                before, x = left, self.parts[x][1]
            else:
                before, y = right + 1, self.parts[y][0]
        self.near[a << 32 | b] = out
        return out

    def whole(self, token: int) -> bool:
        """Whether a token's bytes are encoded as that token."""
        if token not in self.parts:
            return True
        if token not in self.kept:
            ids: list[int] = []
            todo = [token]
            while todo:
                t = todo.pop()
                if t in self.parts:
                    todo += reversed(self.parts[t])
                else:
                    ids.append(t)
            while len(ids) > 1:
                ranks = [self.pairs.get(p, NOWHERE) for p in zip(ids, ids[1:])]  # noqa: B905
                k = min(range(len(ranks)), key=ranks.__getitem__)
                if ranks[k] == NOWHERE:
                    break
                ids[k : k + 2] = [self.made(ids[k], ids[k + 1])]
            self.kept[token] = ids == [token]
        return self.kept[token]

    def made(self, x: int, y: int) -> int:
        if not hasattr(self, "_made"):
            self._made = {parts: t for t, parts in self.parts.items()}
        return self._made[x, y]

    def step(self, state: int, byte: int) -> int:
        """Compiles a transition: 512 times the next state, plus the change in tokens and 256."""
        suffix, chain = self.states[state]
        grown = suffix + bytes([byte])
        found, going = None, []
        for length, last, less in chain:
            text = grown[len(grown) - 1 - length :]
            if found is None and (t := self.tokens.get(text)) is not None and (last < 0 or self.apart(last, t)) and self.whole(t):
                found = t, less + 1
            if text in self.prefixes:
                going.append((length + 1, last, less))
        token, change = found
        # States share what they have in common, so that each costs little memory.
        chain = tuple(self.items.setdefault(x, x) for x in (*((length, last, less - change) for length, last, less in going), (0, token, 0)))
        name = (grown[len(grown) - chain[0][0] :] if chain[0][0] else b"", chain)
        to = self.names.get(name)
        if to is None:
            to = self.names[name] = len(self.states)
            self.states.append(name)
            if to >= len(self.last):
                self.last = np.r_[self.last, np.full(len(self.last), -1, np.int64)]
            self.last[to] = token
        return to << 9 | change + 256

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) & (self.size - 1)

    def _grow(self) -> None:
        old = self.keys >= 0
        keys, moves = self.keys[old], self.moves[old]
        self.size *= 2
        self.keys, self.moves = np.full(self.size, -1, np.int64), np.zeros(self.size, np.int64)
        self.used = 0
        self._insert(keys, moves)

    def _insert(self, keys: np.ndarray, moves: np.ndarray) -> None:
        """Puts new and different keys into the table: of those that want one free slot the last gets it, the others go on."""
        self.used += len(keys)
        if 2 * self.used > self.size:
            self.used -= len(keys)
            self._grow()
            self._insert(keys, moves)
            return
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            put = self.keys[at] == keys
            self.moves[at[put]] = moves[put]
            keys, moves, at = keys[~put], moves[~put], at[~put] + 1 & self.size - 1

    def follow(self, keys: np.ndarray) -> np.ndarray:
        """The transitions of keys (256 times a state, plus a byte)."""
        at = self._slots(keys)
        out = self.moves[at]
        todo = np.flatnonzero(self.keys[at] != keys)
        at = at[todo]
        missing = []
        while len(todo):
            empty = self.keys[at] < 0
            missing.append(todo[empty])
            todo, at = todo[~empty], at[~empty] + 1 & self.size - 1
            hit = self.keys[at] == keys[todo]
            out[todo[hit]] = self.moves[at[hit]]
            todo, at = todo[~hit], at[~hit]
        if missing and len(at := np.concatenate(missing)):
            new, back = np.unique(keys[at], return_inverse=True)
            moves = np.fromiter((self.step(k >> 8, k & 255) for k in new.tolist()), dtype=np.int64, count=len(new))
            self._insert(new, moves)
            out[at] = moves[back]
        return out

    def run(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The transition at each byte: 512 times the state after it, plus the change in tokens and 256.

        first: where pre-tokens start, ascending from 0. Lanes of whole pre-tokens advance together, a byte at a time; the last few
        are finished one by one.
        """
        if self.used > LIMIT:
            self.forget()
        n = len(data)
        moves = np.zeros(n, np.int64)
        if not n:
            return moves
        feed = data.astype(np.int32)
        feed[first] |= 256
        wanted = np.arange(0, n, max(1, n // LANES))
        at = np.unique(first[np.searchsorted(first, wanted, "right") - 1])
        lengths = np.diff(np.r_[at, n])
        order = np.argsort(-lengths, kind="stable")
        at, lengths = at[order], lengths[order]
        lives = np.searchsorted(-lengths, -np.arange(int(lengths[0]) + 1), "left")
        state, step = np.zeros(len(at), np.int64), 0
        while lives[step] > FEW:
            live = lives[step]
            read = feed[at[:live] + step]
            key = np.where(read > 255, read & 255, state[:live] << 8 | read)
            move = self.follow(key)
            state = move >> 9
            moves[at[:live] + step] = move
            step += 1
        for k in range(lives[step]):
            now, memo = int(state[k]), {}
            for i in range(int(at[k]) + step, int(at[k] + lengths[k])):
                read = int(feed[i])
                key = read & 255 if read > 255 else now << 8 | read
                if (move := memo.get(key)) is None:
                    move = memo[key] = int(self.follow(np.array([key]))[0])
                now = move >> 9
                moves[i] = move
        return moves


class Transducer:
    """Counts and ids of a compiled tokenizer."""

    def __init__(self, told: dict, library: Tokenizer):
        self.merges = Merges(told["model"]["vocab"], told["model"]["merges"])
        self.before = library.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.classes = np.full(0x110000, -1, np.int8)

    def learn(self, points: np.ndarray) -> None:
        """Classes of code points that are met for the first time, as the tokenizer's own pre-tokenizer tells them."""
        for p in np.unique(points[self.classes[points] < 0]).tolist():
            joins = lambda c: len(self.before.pre_tokenize_str(c + chr(p))) == 1  # noqa: B023, E731
            self.classes[p] = L if joins("a") else N if joins("1") else O if joins("!") else W

    def symbols(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Symbols of the code points of texts, each followed by one more place (at ends)."""
        self.learn(points)
        out = self.classes[points]
        out[ends] = END
        after = np.r_[out[1:], np.int8(END)]
        out[(out == W) & (after != W) & (after != END)] = LAST
        out[(points == 32) & (out == LAST)] = JOIN
        quote = np.flatnonzero((points == 39) & (out == O))
        follow = lambda k: np.where(quote + k < len(points), points[np.minimum(quote + k, len(points) - 1)], 0)
        # The places between texts hold NUL, which is no part of a contraction.
        one, two = follow(1), follow(2)
        out[quote[(one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))]] = SHORT
        for a, b in ("re", "ve", "ll"):
            out[quote[(one == ord(a)) & (two == ord(b))]] = LONG
        return out

    def encode(self, texts: list[str], ids: bool = False, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray | None]:
        """Tokens of each text, and the ids of all, if asked for."""
        parts, owner = texts, None
        if self.cut and any(s in t for t in texts for s in self.special):
            pieces = [(p, i) for i, t in enumerate(texts) for p in self.cut.split(t)]
            parts, owner = [p for p, _ in pieces], np.array([i for _, i in pieces])
        names = [self.special.get(p) for p in parts] if owner is not None else []
        plain = ["" if p in self.special else p for p in parts] if owner is not None else parts
        lengths = np.fromiter(map(len, plain), dtype=np.int64, count=len(plain))
        joined = "\0".join([*plain, ""])
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        ends = np.cumsum(lengths + 1) - 1
        starts = token_starts(self.symbols(points, ends), chunk)
        inside = np.ones(len(points), dtype=bool)
        inside[ends] = False
        data = np.frombuffer("".join(plain).encode("utf-8", "replace"), np.uint8)
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        first = heads[starts[inside]]
        moves = self.merges.run(data, first)
        stops = np.r_[heads, len(data)][ends - np.arange(len(ends))]
        counts = np.zeros(len(plain), np.int64)
        real = np.flatnonzero(lengths)
        if len(real):
            counts[real] = np.add.reduceat((moves & 511) - 256, np.r_[0, stops[real[:-1]]])
        if owner is not None:
            counts = counts + np.array([n is not None for n in names])
        found = self._ids(len(data), first, moves >> 9, stops, names) if ids else None
        return (counts if owner is None else np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64)), found

    def _ids(self, n: int, first: np.ndarray, states: np.ndarray, stops: np.ndarray, names: list) -> np.ndarray:
        """Tokens are read off backwards from the end of each pre-token: the last one tells where the one before it ends."""
        found = np.full(n, -1, np.int64)
        at, low = np.r_[first[1:], n][: len(first)] - 1, first
        while len(at):
            token = self.merges.last[states[at]]
            found[at] = token
            at = at - self.merges.lengths[token]
            go = at >= low
            at, low = at[go], low[go]
        if any(n is not None for n in names):
            # A special token stands where its own, empty part ends.
            where = [k for k, n in enumerate(names) if n is not None]
            kept = np.flatnonzero(found >= 0)
            return np.insert(found[kept], np.searchsorted(kept, stops[where]), [names[k] for k in where])
        return found[found >= 0]


@lru_cache(maxsize=4)
def compiled(path: str) -> Transducer | None:
    """The transducer of a tokenizer file, or None if it isn't a byte-level BPE of the kind that can be compiled."""
    if not path.endswith(".json"):
        return None
    told = json.loads(Path(path).read_text())
    before, model = told.get("pre_tokenizer") or {}, told["model"]
    if before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space") or told.get("normalizer"):
        return None
    if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in told.get("added_tokens", [])):
        return None
    out = Transducer(told, Tokenizer.from_file(path))
    return out if out.merges.sound else None
