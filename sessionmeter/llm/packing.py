"""Best-fit packing of token sequences by bin completion.

Only lengths decide how pieces pack, and there are at most ``capacity`` of them, so the search
works on a histogram: one row per length, whatever the number of documents. Its result is a
list of *fillings* (lengths that share a sequence) with how often each is used; pieces take
their places by their rank within their length, which Spark computes in blocks.

Bin completion: the largest remaining length opens a sequence, its undominated completions are
enumerated (a completion is dominated if swapping one of its parts for a larger remaining one
still fits), and each choice is used several times at once. Branch and bound goes
through the choices depth first, best fit first; a branch ends when the waste so far already
needs as many sequences as the best plan known (the incumbent, at first best-fit decreasing).
The first round tries ``BRANCHES`` completions at a node, each as often as the counts allow; every
further round twice as many, and one more halving of how often. The search stops at the lower
bound ceil(tokens / capacity) and its variants, or after ``NODES`` nodes of all rounds, when the
incumbent, a complete plan, is used. Behind the third part of a completion only the largest that
fits is tried, so the end of all rounds proves nothing by itself.

Null and empty texts become the end token alone. Repeated rows are packed each; a null doc_id is
packed like any other; an empty table gives an empty one. Longer documents are cut into pieces
of ``capacity``; nothing is dropped.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, slices, stored
from .wordtokens import word_tokenizer

CAPACITY = 2048
#: Effort of the search: nodes in all, completions tried at a node in the first round.
NODES, BRANCHES = 20_000, 3
#: Pieces of one length that one task ranks.
BLOCK = 50_000


@dataclass
class Filling:
    """``times`` sequences, each holding these (length, copies), the largest first."""

    parts: list[tuple[int, int]]
    times: int


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by volume, and counting what cannot share with large pieces."""
    lengths = sorted(counts)
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    for k in [n for n in lengths if 2 * n <= capacity][:64] + [1]:
        large = sum(c for n, c in counts.items() if n > capacity - k)
        middle = [(n, c) for n, c in counts.items() if capacity - k >= n > capacity / 2]
        small = sum(n * c for n, c in counts.items() if k <= n <= capacity / 2)
        room = sum((capacity - n) * c for n, c in middle)
        need = large + sum(c for _, c in middle) + max(0, -(-(small - room) // capacity))
        best = max(best, need)
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Best-fit decreasing on the histogram: a piece goes where the least room holds it.

    A sequence with the least room keeps it while more pieces of the length fit, so it takes
    ``room // length`` copies at once, and sequences filled alike are one entry.
    """
    held: dict[int, list[Filling]] = {}
    for n in sorted(counts, reverse=True):
        left = counts[n]
        made: list[tuple[int, Filling]] = []
        for room in [*sorted(r for r in held if r >= n), capacity]:
            if not left:
                break
            fit = room // n
            groups = held.pop(room) if room < capacity else [Filling([], left)]  # the last: sequences opened now
            while groups and left:
                group = groups.pop()
                full = min(group.times, left // fit)
                part = left - full * fit if full < group.times else 0
                for copies, times in ((fit, full), (part, 1)):
                    if copies and times:
                        made.append((room - copies * n, Filling([*group.parts, (n, copies)], times)))
                rest = group.times - full - (part > 0)
                left -= full * fit + part
                if rest and group.parts:
                    groups.append(Filling(group.parts, rest))
            if groups:
                held[room] = groups
        for room, group in made:
            held.setdefault(room, []).append(group)
    return [group for room in sorted(held) for group in held[room]]


def _filled(room: int, limit: int, chosen: dict[int, int], counts: dict[int, int], lengths: list[int]) -> tuple[int, dict[int, int]]:
    """Room left and parts after taking, from ``limit`` down, as many copies of each length as fit."""
    chosen = dict(chosen)
    i = bisect_right(lengths, min(room, limit)) - 1
    while i >= 0 and room:
        n = lengths[i]
        copies = min(counts[n] - chosen.get(n, 0), room // n)
        if copies > 0:
            chosen[n] = chosen.get(n, 0) + copies
            room -= copies * n
        i = min(i, bisect_right(lengths, room)) - 1
    return room, chosen


def _dominates(a: dict[int, int], b: dict[int, int]) -> bool:
    """As many parts, each at least as long as its counterpart; the keys of both descend."""
    if sum(a.values()) != sum(b.values()):
        return False
    more, less = list(a.items()), list(b.items())
    i = j = at = past = 0
    while i < len(more):
        if more[i][0] < less[j][0]:
            return False
        step = min(more[i][1] - at, less[j][1] - past)
        at, past = at + step, past + step
        if at == more[i][1]:
            i, at = i + 1, 0
        if past == less[j][1]:
            j, past = j + 1, 0
    return True


def completions(counts: dict[int, int], lengths: list[int], capacity: int, width: int) -> tuple[list[dict[int, int]], int]:
    """Undominated fillings (copies by length, descending) with the largest piece, least waste first.

    ``lengths`` ascends. Enumerated depth first from large to small; the first is the largest
    that fits, and the search ends at a full sequence. Each of the first three parts is one of
    the ``width`` largest that fit; behind them each way is filled up in one step, so every one
    is complete whatever the number of pieces. Also returned: the number of ways tried.
    """
    largest = lengths[-1]
    found: list[tuple[int, dict[int, int]]] = []
    stack: list[tuple[int, int, int, dict[int, int]]] = [(capacity - largest, largest, 0, {largest: 1})]
    while stack:
        room, limit, depth, chosen = stack.pop()
        i = bisect_right(lengths, min(room, limit)) - 1
        nexts = []
        while depth < 3 and i >= 0 and len(nexts) < width:
            if counts[lengths[i]] > chosen.get(lengths[i], 0):
                nexts.append(lengths[i])
            i -= 1
        # An exact fit dominates every other way to use this room.
        if not nexts or nexts[0] == room:
            found.append(_filled(room, limit, chosen, counts, lengths))
            if found[-1][0] == 0:
                break
            continue
        for n in reversed(nexts):
            stack.append((room - n, n, depth + 1, chosen | {n: chosen.get(n, 0) + 1}))
    kept: list[dict[int, int]] = []
    for _, chosen in sorted(found, key=lambda f: (f[0], [(-n, -c) for n, c in f[1].items()])):
        if not any(_dominates(k, chosen) for k in kept):
            kept.append(chosen)
    return kept, len(found)


def _take(counts: dict[int, int], parts: dict[int, int]) -> int:
    """How often a filling can be used."""
    return min(counts[n] // c for n, c in parts.items())


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Filling]:
    """Fillings that use up the histogram, in as few sequences as the search finds."""
    counts = {n: c for n, c in counts.items() if c}
    bound = lower_bound(counts, capacity)
    nodes = 0
    best = best_fit(counts, capacity)
    best_size = sum(f.times for f in best)
    if best_size <= bound:
        return best
    slack = capacity * bound - sum(n * c for n, c in counts.items())
    width, halvings = BRANCHES, 0
    # A frame: its choices left to try, and the filling that led to it (to be undone).
    lengths = sorted(counts)
    used: list[Filling] = []
    size = waste = 0

    def choices():
        nonlocal nodes
        found, ways = completions(counts, lengths, capacity, width)
        nodes += (ways - 1) // BRANCHES ** 3  # wider enumerations are charged as the nodes they take the time of
        return iter([(parts, times) for parts in found[:width] for times in sorted(
            {max(1, _take(counts, parts) >> k) for k in range(halvings + 1)}, reverse=True)])

    def apply(parts: dict[int, int], times: int) -> None:
        nonlocal size, waste
        for n, c in parts.items():
            before = counts[n]
            counts[n] -= c * times
            if counts[n] == 0:
                lengths.pop(bisect_right(lengths, n) - 1)
            elif before == 0:
                lengths.insert(bisect_right(lengths, n), n)
        size += times
        waste += times * (capacity - sum(n * c for n, c in parts.items()))

    # Nothing is left to undo when a round ends, so the next one, twice as wide, starts afresh.
    while True:
        stack = [choices()]
        while stack:
            parts, times = next(stack[-1], (None, 0))
            nodes += 1
            if nodes > NODES:
                return best
            if parts is None:
                stack.pop()
                if used:
                    last = used.pop()
                    apply(dict(last.parts), -last.times)
                continue
            apply(parts, times)
            used.append(Filling(sorted(parts.items(), reverse=True), times))
            # Waste beyond what the volume bound leaves costs whole sequences.
            if bound + max(0, -(-(waste - slack) // capacity)) >= best_size:
                apply(parts, -times)
                used.pop()
                continue
            if not lengths:
                if size < best_size:
                    best, best_size = list(used), size
                if best_size <= bound:
                    return best
                apply(parts, -times)
                used.pop()
                continue
            stack.append(choices())
        if width >= len(lengths) and max(counts.values()) >> halvings <= 1:
            return best
        width, halvings = 2 * width, halvings + 1


END = b"\0\0\0\0"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's tokens, cut where longer than capacity."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(tokenizer_path).encode
        for batch in slices(batches):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(as_bytes(batch.column("text"))), strict=True):
                ids += END
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k:k + 4 * capacity]
                    rows.append((doc, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
            doc, piece, start, length, crc = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _ranked(df: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0 within each length, without gathering a length in one task.

    Pieces of one length are dealt to blocks by a hash, ranked there, and moved up by the
    sizes of the blocks before.
    """
    sizes = df.groupBy("length").count().select("length", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = df.join(F.broadcast(sizes), "length").withColumn(  # a row per length: capacity at most
        "block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "blocks"))
    before = dealt.groupBy("length", "block").count().withColumn("before", F.coalesce(F.sum("count").over(
        Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    order = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("place", F.row_number().over(order) - 1)
    return ranked.join(before, ["length", "block"]).withColumn("rank", F.col("place") + F.col("before")).drop("block", "blocks", "place", "before")


def _places(fillings: list[Filling]) -> dict[int, list[np.ndarray]]:
    """Per length: first rank, first sequence, copies, offset of the first copy, for each filling with it."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for filling in fillings:
        offset = 0
        for n, copies in filling.parts:
            rows.setdefault(n, []).append((rank.get(n, 0), sequence, copies, offset))
            rank[n] = rank.get(n, 0) + copies * filling.times
            offset += n * copies
        sequence += filling.times
    return {n: list(np.array(r, np.int64).T) for n, r in rows.items()}


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (a stored frame with doc_id, piece, length, ids_crc32)."""
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # capacity rows at most
    places = _places(plan(counts, capacity))
    ranked = _ranked(found)
    names = [f.name for f in ranked.schema.fields if f.name != "rank"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                first, base, copies, start = places[int(n)]
                at = np.searchsorted(first, rank[own], "right") - 1
                nth = rank[own] - first[at]
                sequence[own] = base[at] + nth // copies[at]
                offset[own] = start[at] + n * (nth % copies[at])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank")
    return ranked.mapInArrow(work, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stored(pieces(docs, tokenizer_path, capacity)), capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
