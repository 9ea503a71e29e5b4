"""Packing tokenized documents into sequences by bin completion.

Only the lengths of pieces matter for packing, and there are at most `capacity` of them. So the plan is made from the
histogram of all lengths (a table of bounded size), as patterns that are each used so many times; every piece then finds
its place by its rank within its length. The search covers the whole corpus at a cost that doesn't grow with it. It is a complete
branch and bound; a budget of steps may end it before it has proved its plan, which it tells.
"""

from __future__ import annotations

import logging
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batch, id_ranks, materialize, require, tidy
from gridloom.llm.tokens import encode_spans

log = logging.getLogger(__name__)
#: Fillings that a node takes, and the price of a piece in units of waste, in each pass of the search.
PASSES = ((2, 16), (2, 8), (2, 1), (2, 0), (6, 4), (24, 1), (None, 0))
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: a document's ids and the end id, cut from the right, so that only its first piece is shorter."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            names, texts, out = rows.column(0).to_pylist(), [x or "" for x in rows.column(1).to_pylist()], []
            for first, counts, flat in encode_spans(texts, tokenizer, True):
                data, at = flat.astype("<u4").tobytes(), 0
                for k, n in enumerate(counts.tolist(), first):
                    ids = memoryview(data[4 * at : 4 * (at + n)] + end)
                    at += n
                    stops = [*range((n + 1) % capacity or capacity, n + 1, capacity), n + 1]
                    for piece, (start, stop) in enumerate(zip([0, *stops], stops)):  # noqa: B905
                        out.append((names[k], piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
            yield tidy(batch(schema, **dict(zip(schema.names, zip(*out) if out else [()] * 5, strict=True))))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: no packing of these lengths has fewer bins."""
    best = -(-sum(s * n for s, n in counts.items()) // capacity)
    for small in sorted({0, *(s for s in counts if 2 * s <= capacity)}):
        big = sum(n for s, n in counts.items() if s > capacity - small)
        half = [(s, n) for s, n in counts.items() if capacity - small >= s and 2 * s > capacity]
        rest = sum(s * n for s, n in counts.items() if small <= s and 2 * s <= capacity and s > 0)
        free = sum((capacity - s) * n for s, n in half)
        best = max(best, big + sum(n for _, n in half) + max(0, -(-(rest - free) // capacity)))
    return best


Pattern = tuple[tuple[int, int], ...]
Plan = list[tuple[Pattern, int]]


def uses(fill: list[int], counts: dict[int, int]) -> tuple[Pattern, int]:
    """A filling as (length, number) pairs, and how many bins it can fill."""
    per = {s: fill.count(s) for s in fill}
    return tuple(sorted(per.items(), reverse=True)), min(counts[s] // n for s, n in per.items())


def take(counts: dict[int, int], pattern: Pattern, times: int) -> dict[int, int]:
    left = dict(counts)
    for s, n in pattern:
        left[s] -= n * times
        if not left[s]:
            del left[s]
    return left


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, as the first incumbent: the largest lengths first, each bin topped up with the largest that fits."""
    plan: Plan = []
    while counts:
        sizes = np.array(sorted(counts))
        used: dict[int, int] = {}
        fill, room = [], capacity
        while (k := int(np.searchsorted(sizes, room, "right"))) > 0:
            while k and used.get(int(sizes[k - 1]), 0) >= counts[int(sizes[k - 1])]:
                k -= 1
            if not k:
                break
            s = int(sizes[k - 1])
            used[s] = used.get(s, 0) + 1
            fill.append(s)
            room -= s
        pattern, times = uses(fill, counts)
        plan.append((pattern, times))
        counts = take(counts, pattern, times)
    return plan


@dataclass
class Budget:
    left: int

    def spend(self) -> bool:
        self.left -= 1
        return self.left >= 0


def fillings(counts: dict[int, int], capacity: int, most_waste: int, price: int, budget: Budget) -> Iterator[tuple[list[int], int]]:
    """All undominated fillings around the largest length that waste no more than allowed, with their waste.

    They come in the order of their waste plus `price` times their pieces, as many pieces use up the small lengths that later bins
    need, and those of larger lengths before others. Sets of the sums that p pieces make guide the enumeration. A filling is
    dominated, and left out, if it leaves room for a length that is left, or if such a length can stand in for one or two
    smaller or equally large in sum that it holds.
    """
    top = max(counts)
    room = capacity - top
    left = {s: n - (s == top) for s, n in counts.items() if s <= room and n > (s == top)}
    sizes, mask = sorted(left), (1 << room + 1) - 1
    sums = [1]

    def made(p: int, total: int) -> int:
        """Whether p pieces, if every length were there often enough, make a total."""
        while len(sums) <= p:
            bits = 0
            for s in sizes:
                bits |= sums[-1] << s & mask
            sums.append(bits)
        return sums[p] >> total & 1

    most_waste = min(most_waste, room)
    if sizes and left[sizes[0]] > room // sizes[0]:
        most_waste = min(most_waste, sizes[0] - 1)
    most_pieces = room // sizes[0] if sizes else 0
    for cost in range(most_waste + price * most_pieces + 1):
        for pieces in range(min(most_pieces, cost // price if price else most_pieces) + 1):
            waste = cost - price * pieces
            if waste > most_waste or not made(pieces, room - waste):
                continue
            stack: list[tuple[int, int, tuple[int, ...]]] = [(pieces, room - waste, ())]
            while stack:
                p, rest, chosen = stack.pop()
                if not budget.spend():
                    return
                if not p:
                    if not dominated(chosen, left, sizes, waste):
                        yield [top, *chosen], waste
                    continue
                low, high = bisect_left(sizes, -(-rest // p)), bisect_right(sizes, min(rest, chosen[-1] if chosen else rest))
                stack.extend((p - 1, rest - s, (*chosen, s)) for s in sizes[low:high] if made(p - 1, rest - s) and left[s] > chosen.count(s))


def dominated(chosen: tuple[int, ...], left: dict[int, int], sizes: list[int], waste: int) -> bool:
    used = Counter(chosen)
    free = lambda low, high: any(left[s] > used[s] for s in sizes[bisect_left(sizes, low) : bisect_right(sizes, high)])
    if free(1, waste) or any(free(s + 1, s + waste) for s in used):
        return True
    pairs = {a + b for i, a in enumerate(used) for b in list(used)[i + 1 :]} | {2 * s for s, n in used.items() if n > 1}
    return any(free(p, p + waste) for p in pairs)


@dataclass
class Packed:
    """A plan, its sequences, the bound that no packing goes below, and whether none has fewer."""

    plan: Plan
    bins: int
    bound: int
    proven: bool


def bin_completion(counts: dict[int, int], capacity: int, budget: int = 200_000) -> Packed:
    """Branch and bound over fillings around the largest length.

    A filling is used as often as the counts allow or, as a branch of its own, once, so every packing by undominated
    fillings is reached. A node is cut when its bins and its waste leave no better packing than the incumbent, which
    starts as the best-fit plan. The search broadens: each pass may take more fillings per node than the one before, the last one all
    of them. It stops at the lower bound, when a pass has left nothing out, or after `budget` steps, of the
    search or within a filling, of which each pass has an equal share.
    """
    counts = {s: n for s, n in counts.items() if n}
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    fewest = sum(n for _, n in best)
    cut = False

    def children(left: dict[int, int], bins: int, spare: int, width: int | None, price: int, steps: Budget) -> Iterator[tuple[dict[int, int], int, tuple[Pattern, int]]]:
        nonlocal cut
        for often in (True, False):
            for k, (fill, waste) in enumerate(fillings(left, capacity, spare, price, steps)):
                if k == width:
                    cut = True
                    break
                pattern, most = uses(fill, left)
                if waste:
                    most = min(most, spare // waste)
                if often or most > 1:
                    times = most if often else 1
                    yield take(left, pattern, times), bins + times, (pattern, times)

    def spare_of(left: dict[int, int], bins: int) -> int:
        """What may still be wasted by a packing of fewer bins than the incumbent."""
        return (fewest - 1 - bins) * capacity - sum(s * n for s, n in left.items())

    for width, price in PASSES:
        if not counts or fewest == bound:
            break
        steps, cut, path = Budget(budget // len(PASSES)), False, []
        stack = [children(counts, 0, spare_of(counts, 0), width, price, steps)]
        while stack and fewest > bound and steps.left > 0:
            step = next(stack[-1], None)
            if step is None:
                stack.pop()
                if path:
                    path.pop()
                continue
            left, bins, used = step
            if not left:
                if bins < fewest:
                    best, fewest = [*path, used], bins
                continue
            if not steps.spend() or (spare := spare_of(left, bins)) < 0:
                continue
            path.append(used)
            stack.append(children(left, bins, spare, width, price, steps))
        if steps.left > 0 and not cut:
            return Packed(best, fewest, bound, True)
    return Packed(best, fewest, bound, fewest == bound)


def slots(plan: Plan) -> dict[int, np.ndarray]:
    """length -> rows (first rank, pieces per sequence, first sequence, first offset), by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for s, n in pattern:
            out.setdefault(s, []).append((ranks.get(s, 0), n, sequence, offset))
            ranks[s] = ranks.get(s, 0) + n * times
            offset += s * n
        sequence += times
    return {s: np.array(rows, dtype=np.int64) for s, rows in out.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, budget: int = 200_000) -> DataFrame:
    """Packs docs(doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece.

    A null text counts as empty and packs its end id. Repeated rows and repeated ids are packed once each, null ids are
    kept, an empty table gives no rows, other columns are ignored. Ties within a length go by doc_id and piece, so reruns
    agree. No document is dropped or shortened; a long one is cut into pieces of `capacity` with a shorter first piece.
    How many sequences there are, the bound and whether it is proven that none has fewer go to the log.
    """
    require(docs, "doc_id", "text")
    cut = materialize(pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    packed = bin_completion(counts, capacity, budget)
    log.info("%d sequences, at least %d, %s", packed.bins, packed.bound, "proven" if packed.proven else "not proven")
    places = slots(packed.plan)
    ranked = id_ranks(cut, ["length"], ["doc_id", "piece", "ids_crc32"], "rank")
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            length, rank = rows.column("length").to_numpy(), rows.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if not len(part):
                    continue
                t = places[int(length[part[0]])]
                row = t[np.searchsorted(t[:, 0], rank[part], "right") - 1]
                nth, slot = np.divmod(rank[part] - row[:, 0], row[:, 1])
                sequence[part], offset[part] = row[:, 2] + nth, row[:, 3] + slot * length[part]
            kept = rows.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], [*kept.schema.names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, fields)
