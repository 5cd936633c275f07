"""Clause-level change sets: two versions of a text aligned clause by clause.

Clauses that occur once on both sides are anchors; the longest run of anchors in the order of both sides
stays, and the stretches between are aligned alike. A stretch without anchors loses its equal ends, and
the rest is aligned by a longest common subsequence. Clauses left over that are equal on both sides have
moved; of the others, those at the same turn of the same stretch were edited, and the rest were removed
or added.

A task holds 16 bytes of hash and a place per clause of one pair of versions; texts join the result
afterwards. Work is linear in the clauses but for stretches without anchors, where it is the product of
their lengths in words of bits.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bits of a table of common subsequence lengths held at once; longer stretches are halved first.
TABLE_BITS = 1 << 28
MOVED, EDITED, ADDED, REMOVED = "moved", "edited", "added", "removed"


def split_clauses(rows: DataFrame, key: str, text: str | Column, separator: str = "\n") -> DataFrame:
    """(key, pos, clause) per clause of a text; a null text has none."""
    return rows.select(key, F.posexplode(F.split(text, separator, -1)).alias("pos", "clause"))


def rising_run(values: list[int]) -> list[int]:
    """Numbers of the elements of a longest rising subsequence: patience piles, each element behind the
    one last laid on the pile before its own."""
    tops: list[int] = []
    top_at: list[int] = []
    behind = []
    for i, value in enumerate(values):
        pile = bisect_left(tops, value)
        behind.append(top_at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(value)
            top_at.append(i)
        else:
            tops[pile], top_at[pile] = value, i
    run, at = [], top_at[-1] if top_at else -1
    while at >= 0:
        run.append(at)
        at = behind[at]
    return run[::-1]


def _table_rows(a: list[int], b: list[int]) -> Iterator[int]:
    """Bit vectors after 0, 1, ... elements of ``a``; a zero bit j is a step of the common length at b[j]."""
    where: dict[int, int] = defaultdict(int)
    for j, value in enumerate(b):
        where[value] |= 1 << j
    every = row = (1 << len(b)) - 1
    yield row
    for value in a:
        hit = row & where.get(value, 0)
        row = ((row + hit) | (row - hit)) & every
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Common lengths of ``a`` with every prefix of ``b``."""
    for last in _table_rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(last.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_subsequence(a: list[int], b: list[int], table_bits: int = TABLE_BITS) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence."""
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > table_bits:
        middle = len(a) // 2
        sums = _lengths(a[:middle], b) + _lengths(a[middle:][::-1], b[::-1])[::-1]
        cut = int(sums.argmax())
        return common_subsequence(a[:middle], b[:cut], table_bits) + [
            (i + middle, j + cut) for i, j in common_subsequence(a[middle:], b[cut:], table_bits)]
    rows = list(_table_rows(a, b))

    def length(i: int, j: int) -> int:
        return j - (rows[i] & ((1 << j) - 1)).bit_count()

    pairs, i, j = [], len(a), len(b)
    here = length(i, j)
    while here:
        if length(i - 1, j) == here:
            i -= 1
        elif length(i, j - 1) == here:
            j -= 1
        else:
            i, j, here = i - 1, j - 1, here - 1
            pairs.append((i, j))
    return pairs[::-1]


def kept_pairs(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (in a, in b) of the clauses that stay, in order."""
    kept: list[tuple[int, int]] = []
    open_ = [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = _once(a, a0, a1), _once(b, b0, b1)
        anchors = sorted((i, once_b[value]) for value, i in once_a.items() if value in once_b)
        if anchors:
            run = [anchors[n] for n in rising_run([j for _, j in anchors])]
            kept += run
            for (i, j), (i2, j2) in zip([(a0 - 1, b0 - 1), *run], [*run, (a1, b1)], strict=True):
                open_.append((i + 1, i2, j + 1, j2))
            continue
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            kept.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            kept.append((a1, b1))
        kept += [(i + a0, j + b0) for i, j in common_subsequence(a[a0:a1], b[b0:b1])]
    return sorted(kept)


def _once(values: list[int], first: int, last: int) -> dict[int, int]:
    """Place of every value that occurs once in a stretch."""
    place: dict[int, int] = {}
    twice = set()
    for i in range(first, last):
        if values[i] in place:
            twice.add(values[i])
        place[values[i]] = i
    return {value: i for value, i in place.items() if value not in twice}


def changes(a: list[int], b: list[int]) -> list[tuple[str, int | None, int | None]]:
    """(change, place in a, place in b) of everything that did not stay."""
    kept = kept_pairs(a, b)
    in_a, in_b = {i for i, _ in kept}, {j for _, j in kept}
    new_places: dict[int, list[int]] = defaultdict(list)
    for j in range(len(b) - 1, -1, -1):
        if j not in in_b:
            new_places[b[j]].append(j)
    found: list[tuple[str, int | None, int | None]] = []
    moved_a, moved_b = set(), set()
    for i, value in enumerate(a):
        if i not in in_a and new_places.get(value):
            j = new_places[value].pop()
            found.append((MOVED, i, j))
            moved_a.add(i)
            moved_b.add(j)
    for (i, j), (i2, j2) in zip([(-1, -1), *kept], [*kept, (len(a), len(b))], strict=True):
        old = [x for x in range(i + 1, i2) if x not in moved_a]
        new = [x for x in range(j + 1, j2) if x not in moved_b]
        both = min(len(old), len(new))
        found += [(EDITED, x, y) for x, y in zip(old, new)]
        found += [(REMOVED, x, None) for x in old[both:]] + [(ADDED, None, y) for y in new[both:]]
    return found


def clause_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change, old_pos, new_pos, old_clause, new_clause) of every clause that moved, was edited,
    added or removed between two versions.

    ``old`` and ``new`` are (key, pos, clause); clauses are ordered by pos, which is unique per key. A
    null clause equals no other but null ones. Keys on one side only have all their clauses added or
    removed; rows with a null key take no part; empty tables give no rows.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        digest = F.unhex(F.substring(F.sha2(F.coalesce(F.concat(F.lit("t"), "clause"), F.lit("")), 256), 1, 32))
        return df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.lit(name).alias("side"), F.col("pos").cast("long"), digest.alias("hash"))

    both = side(old, "old").unionByName(side(new, "new"))
    schema = T.StructType([both.schema["key"], T.StructField("change", T.StringType()),
                           T.StructField("old_pos", T.LongType()), T.StructField("new_pos", T.LongType())])

    def align(group: pa.Table) -> pa.Table:
        table = group.sort_by([("side", "descending"), ("pos", "ascending")])
        is_old = int(np.count_nonzero(table.column("side").to_numpy(zero_copy_only=False) == "old"))
        numbers = table.column("hash").combine_chunks().dictionary_encode().indices.to_pylist()
        place = table.column("pos").to_pylist()
        found = changes(numbers[:is_old], numbers[is_old:])
        kind = table.schema.field("key").type
        return pa.table([
            pa.array([table.column("key")[0].as_py()] * len(found), kind), pa.array([c for c, _, _ in found], pa.string()),
            pa.array([None if i is None else place[i] for _, i, _ in found], pa.int64()),
            pa.array([None if j is None else place[is_old + j] for _, _, j in found], pa.int64())], names=["key", "change", "old_pos", "new_pos"])

    found = both.groupBy("key").applyInArrow(align, schema)
    for name, df in (("old", old), ("new", new)):
        said = df.select(F.col(key).alias("_key"), F.col("pos").cast("long").alias("_pos"), F.col("clause").alias(f"{name}_clause"))
        found = found.join(said, (F.col("key") == F.col("_key")) & (F.col(f"{name}_pos") == F.col("_pos")), "left").drop("_key", "_pos")
    return found.withColumnRenamed("key", key)
