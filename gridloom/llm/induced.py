"""Suffix sorting by induction, with queues that go to disk.

Suffixes are taken from a monotone priority queue, whose keys are first symbols and whose order within a key is that of
arrival: the smallest suffix induces the place of the suffix one symbol longer. All suffixes of one key that are known at
a time are taken and induced together, as arrays. A queue keeps its positions in memory up to a limit and appends
the rest to an unlinked scratch file, from which it reads them back key by key. The text of a shard, its suffix array and its names
are in memory; shards are made small enough for that.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes of a queue that stay in memory.
IN_MEMORY = 64 << 20
#: More names than this are sorted by doubling, as each key costs a step of the queue.
FEW = 1024


class BucketQueue:
    """key -> positions, in order of arrival."""

    def __init__(self, keys: int, in_memory: int = IN_MEMORY):
        self.parts: list[list[np.ndarray | tuple[int, int]]] = [[] for _ in range(keys)]
        self.left, self.file = in_memory, None

    def push(self, key: int, positions: np.ndarray) -> None:
        if positions.nbytes <= self.left:
            self.left -= positions.nbytes
            self.parts[key].append(positions)
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        self.file.write(positions.tobytes())
        self.parts[key].append((at, len(positions)))

    def push_all(self, keys: np.ndarray, positions: np.ndarray) -> None:
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, positions = keys[order], positions[order]
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        at = [0, *cuts.tolist(), len(keys)]
        for key, i, j in zip([int(keys[0]), *keys[cuts].tolist()], at, at[1:]):
            self.push(key, positions[i:j])

    def pop(self, key: int) -> np.ndarray:
        """All positions that wait under a key; they leave the queue."""
        parts, self.parts[key] = self.parts[key], []
        out = []
        for p in parts:
            if isinstance(p, tuple):
                self.file.seek(p[0])
                out.append(np.frombuffer(self.file.read(4 * p[1]), np.int32))
            else:
                self.left += p.nbytes
                out.append(p)
        return np.concatenate(out) if out else np.empty(0, np.int32)


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last counts as smaller."""
    change = np.flatnonzero(text[:-1] != text[1:])
    lengths = np.diff(change, prepend=-1, append=len(text) - 1)
    return np.repeat(np.append(text[change] < text[change + 1], True), lengths)


def induce(text: np.ndarray, keys: int, rises: np.ndarray, seeds: np.ndarray, in_memory: int) -> np.ndarray:
    """The suffix array, given the seeds (suffixes that rise after one that falls) in their order."""
    falling, rising = BucketQueue(keys, in_memory), BucketQueue(keys, in_memory)
    seeded = BucketQueue(keys, in_memory)
    seeded.push_all(text[seeds], seeds)
    sorted_falls = BucketQueue(keys, in_memory)
    for key in range(keys):
        while len(group := falling.pop(key)):
            sorted_falls.push(key, group)
            before = group[group > 0] - 1
            before = before[~rises[before]]
            falling.push_all(text[before], before)
        if len(group := seeded.pop(key)):
            before = group[group > 0] - 1
            before = before[~rises[before]]
            falling.push_all(text[before], before)
    out = np.empty(len(text), np.int32)
    end = len(text)
    last = np.array([len(text) - 1], dtype=np.int32)
    rising.push(int(text[-1]), last)
    for key in range(keys - 1, -1, -1):
        while len(group := rising.pop(key)):
            out[end - len(group) : end] = group[::-1]
            end -= len(group)
            before = group[group > 0] - 1
            before = before[rises[before]]
            rising.push_all(text[before], before)
        if len(group := sorted_falls.pop(key)):
            out[end - len(group) : end] = group
            end -= len(group)
            before = group[::-1]
            before = before[before > 0] - 1
            before = before[rises[before]]
            rising.push_all(text[before], before)
    return out


def windows(text: np.ndarray) -> np.ndarray:
    """The eight bytes of symbols from each place on, as a number; 0 stands beyond the end."""
    padded = np.concatenate([text, np.zeros(8 // text.itemsize, text.dtype)])
    return np.ndarray(len(text), "<u8", padded, strides=(text.itemsize,)).copy()


def doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes by their first `depth` names at least. What stands alone already isn't sorted again."""
    n, width = len(names), 1
    order = np.argsort(names, kind="stable")
    key, left = names[order], np.arange(n)
    rank = np.empty(n, np.int64)  # where the first suffix stands that isn't told apart
    while True:
        new = np.ones(len(left), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        cuts = np.flatnonzero(new)
        rank[order[left]] = np.repeat(left[cuts], np.diff(cuts, append=len(left)))
        alone = new & np.append(new[1:], True)
        left = left[~alone]
        if not len(left) or width >= depth:
            return order
        at = order[left]
        ahead = at + width
        key = rank[at] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        pick = np.argsort(key)
        key, order[left], width = key[pick], at[pick], 2 * width


def suffix_array(text: np.ndarray, keys: int, depth: int, in_memory: int = IN_MEMORY) -> np.ndarray:
    """Positions of text (symbols below keys) in the order of their suffixes, exact in the first `depth` symbols at least.

    The last symbol must be 0, which stands nowhere else. Suffixes that agree in `depth` symbols stand together, in any order.
    """
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    rises = smaller_than_next(text)
    seeds = (np.flatnonzero(rises[1:] & ~rises[:-1]) + 1).astype(np.int32)
    if not len(seeds):
        return induce(text, keys, rises, seeds, in_memory)
    first = induce(text, keys, rises, seeds, in_memory)
    is_seed = np.zeros(n, dtype=bool)
    is_seed[seeds] = True
    ordered = first[is_seed[first]]
    # Two seeds get one name if they agree up to the next seed, including it.
    stop = np.full(n, n - 1, np.int32)
    stop[seeds[:-1]] = seeds[1:]
    a, b = ordered[:-1], ordered[1:]
    length = stop[a] - a
    alike = length == stop[b] - b
    at = np.flatnonzero(alike)
    words, each, k = windows(text), 8 // text.itemsize, 0
    masks = np.array([(1 << 8 * text.itemsize * i) - 1 for i in range(each + 1)], np.uint64)
    while len(at):
        mask = masks[np.minimum(length[at] + 1 - k, each)]
        differ = (words[a[at] + k] ^ words[b[at] + k]) & mask != 0
        alike[at[differ]] = False
        k += each
        at = at[~differ & (length[at] >= k)]
    names = np.cumsum(np.r_[0, ~alike])
    count = int(names[-1]) + 1
    if count < len(seeds):
        name_of = np.empty(n, np.int32)
        name_of[ordered] = names
        reduced = name_of[seeds]
        if count < FEW:
            reduced = np.r_[reduced + 1, 0]
            inner = suffix_array(reduced.astype(np.int16), count + 1, depth, in_memory)[1:]
        else:
            inner = doubled(reduced, (depth + 1) // 2)  # a name stands for two symbols at least
        ordered = seeds[inner]
    return induce(text, keys, rises, ordered.astype(np.int32), in_memory)
