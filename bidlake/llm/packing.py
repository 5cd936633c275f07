"""Best-fit packing of documents into sequences after Martello-Toth dominance reduction.

Lengths are at most the capacity, so documents fall into as many classes as there are lengths. The
whole table is one histogram of these classes; the plan (which lengths share a sequence, and how many
such sequences) is made on that histogram, whose size the capacity bounds, and is then laid over
documents by their rank in their class. Ranks need no sort of a class: each task numbers its own
pieces, and a window over the counts of tasks adds what comes before.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidlake.llm.common import stage, text_steps
from bidlake.llm.tokens import Encoder

CAPACITY = 2048
SEPARATOR_ID = 0


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix sets that dominate every alternative and take them out of ``counts`` (length: how many).

    For the longest length still open, with the two shortest others giving the bound on company:
    nothing fits: it stands alone; one length fills the sequence exactly: that pair; at most one
    other fits: the longest that fits; at most two fit: the longest that fits, if no fitting pair
    sums to more, or the pair of the longest that fits and the longest beside it, if that second
    one is at least the smaller half of any fitting pair. A length for which none of these holds
    is passed over; passes repeat until one fixes nothing. Returns (lengths, how many) patterns.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    changed = True
    while changed:
        changed = False
        for j in sorted(counts, reverse=True):
            while counts.get(j):
                found = _dominating(j, counts, capacity)
                if not found:
                    break
                need = {x: found.count(x) for x in found}
                times = min(counts[x] // k for x, k in need.items())
                for x, k in need.items():
                    counts[x] -= k * times
                    if not counts[x]:
                        del counts[x]
                fixed.append((tuple(sorted(found, reverse=True)), times))
                changed = True
    return fixed


def _dominating(j: int, counts: dict[int, int], capacity: int) -> tuple[int, ...] | None:
    left = dict(counts)
    left[j] -= 1
    sizes = sorted(x for x, k in left.items() if k)
    gap = capacity - j
    if not sizes or sizes[0] > gap:
        return (j,)
    best = sizes[bisect_right(sizes, gap) - 1]
    if best == gap:
        return (j, best)
    shortest = [x for x in sizes[:3] for _ in range(min(left[x], 3))][:3]
    if len(shortest) < 2 or shortest[0] + shortest[1] > gap:
        return (j, best)
    if len(shortest) == 3 and sum(shortest) <= gap:
        return None
    # at most two others fit
    pair = _longest_pair(sizes, left, gap)
    if pair is None or best >= sum(pair):
        return (j, best)
    left[best] -= 1
    beside = max((x for x in sizes if left[x] and x <= gap - best), default=None)
    left[best] += 1
    if beside is None:
        return None
    half = max((x for x in sizes if 2 * x <= gap and (left[x] > 1 or sizes[bisect_right(sizes, gap - x) - 1] > x)), default=0)
    return (j, best, beside) if beside >= half else None


def _longest_pair(sizes: list[int], left: dict[int, int], gap: int) -> tuple[int, int] | None:
    best = None
    for x in sizes:
        at = bisect_right(sizes, gap - x) - 1
        if at < 0:
            break
        y = sizes[at]
        if y == x and left[x] < 2:
            at -= 1
            if at < 0:
                continue
            y = sizes[at]
        if best is None or x + y > sum(best):
            best = (x, y)
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over classes: each length goes to the open sequences with the least room
    that still holds it. Sequences of equal content are one group, which splits when only a part
    of it takes an item. Returns (lengths, how many) patterns."""
    groups: dict[int, list[list]] = {}  # room: [[lengths, how many], ...]
    rooms: list[int] = []

    def put(room: int, lengths: tuple, times: int) -> None:
        if room not in groups:
            rooms.insert(bisect_left(rooms, room), room)
            groups[room] = []
        groups[room].append([lengths, times])

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                full, rest = divmod(n, each)
                if full:
                    put(capacity - each * size, (size,) * each, full)
                if rest:
                    put(capacity - rest * size, (size,) * rest, 1)
                n = 0
                break
            room = rooms[at]
            lengths, times = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            # a sequence that took an item has the least room left, so it is filled to its end
            each = room // size
            used = min(times, n // each)
            if not used:
                used, each = 1, n
            if used < times:
                put(room, lengths, times - used)
            put(room - each * size, lengths + (size,) * each, used)
            n -= used * each
    return [(tuple(lengths), times) for held in groups.values() for lengths, times in held]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, how many sequences) that pack ``counts`` (length: how many)."""
    left = {s: n for s, n in counts.items() if n}
    if any(s < 1 or s > capacity for s in left):
        raise ValueError("a length is outside 1..capacity")
    return reduce_by_dominance(left, capacity) + best_fit(left, capacity)


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first rank, first sequence, places per sequence, offset of the first place."""
    slots: dict[int, list] = {}
    filled: dict[int, int] = {}
    sequence = 0
    for lengths, times in patterns:
        at = 0
        for size in sorted(set(lengths), reverse=True):
            k = lengths.count(size)
            slots.setdefault(size, []).append((filled.get(size, 0), sequence, k, at))
            filled[size] = filled.get(size, 0) + k * times
            at += k * size
        sequence += times
    return {s: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for s, rows in slots.items()}


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, separator: int = SEPARATOR_ID) -> DataFrame:
    """Encode and cut: doc_id, piece, start, length, ids_crc32, part, place.

    ``place`` numbers the pieces of one length within one task (``part``).
    """
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        seen = np.zeros(capacity + 1, np.int64)
        for batch, data, starts in text_steps(batches):
            ids, before = encoder.encode(data, starts)
            ids = np.insert(ids, before[1:], np.uint32(separator))
            before = before + np.arange(len(before))
            total = np.diff(before)
            parts = -(-total // capacity)
            doc = np.repeat(np.arange(len(total)), parts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
            first = total - (parts - 1) * capacity  # the first piece takes what is over
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[doc], capacity)
            order = np.argsort(length, kind="stable")
            sizes, counts = np.unique(length, return_counts=True)
            place = np.empty(len(length), np.int64)
            place[order] = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen[sizes], counts)
            seen[sizes] += counts
            view = memoryview(ids.astype("<u4")).cast("B")
            begin = ((before[doc] + start) * 4).tolist()
            crc = [zlib.crc32(view[a:a + 4 * n]) for a, n in zip(begin, length.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(pa.array(doc)), "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()), "place": pa.array(place, pa.int64())})

    cut_rows = kept.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, place long")
    return cut_rows.withColumn("part", F.spark_partition_id())


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, separator: int = SEPARATOR_ID) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null text is empty and
    holds its separator alone; repeated rows are packed each; null ids stay null; no documents give
    no rows; other columns are not read.
    """
    held = stage(pieces(docs, vocabulary, capacity, separator), "pieces")
    per_task = held.groupBy("part", "length").agg(F.count("*").alias("n"))
    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = per_task.select("part", "length", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("ahead"))
    # at most ``capacity`` rows
    counts = {r.length: r.n for r in held.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(plan(counts, capacity))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("place").to_numpy() + batch.column("ahead").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                rows = np.flatnonzero(length == size)
                first, sequences, each, at = slots[int(size)]
                i = np.searchsorted(first, rank[rows], side="right") - 1
                within = rank[rows] - first[i]
                sequence[rows] = sequences[i] + within // each[i]
                offset[rows] = at[i] + within % each[i] * size
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return held.join(ahead, ["part", "length"]).mapInArrow(
        lay, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
