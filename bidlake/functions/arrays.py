"""Linear passes over the array of one row.

A plain fold that appends to an array copies it at every step, which is quadratic. ``scan`` cuts the
array into pieces of fixed size instead: a first fold carries a state of fixed size over the pieces and
notes it at the start of each, and each piece is then folded by itself from there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often and deep ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column],
         state_type: str, out_type: str, piece: int = PIECE) -> Column:
    """``emit(state, item)`` for every item, where ``state`` is what ``step`` made of the items before it.

    ``start`` is the state before the first item; states have a fixed size. A null array gives null.
    """
    def cut(x: Column) -> Column:
        last = F.greatest(F.ceil(F.size(x) / piece) - 1, F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda p: F.slice(x, p * piece + 1, F.lit(piece)))

    def along(pieces: Column) -> Column:
        first = F.struct(start.cast(state_type).alias("state"), F.array().cast(f"array<{state_type}>").alias("seen"))
        return F.aggregate(pieces, first, lambda acc, part: F.struct(
            F.aggregate(part, acc["state"], lambda s, x: step(s, x).cast(state_type)).alias("state"),
            F.concat(acc["seen"], F.array(acc["state"])).alias("seen")), lambda acc: acc["seen"])

    def inside(part: Column, entry: Column) -> Column:
        first = F.struct(entry.alias("state"), F.array().cast(f"array<{out_type}>").alias("out"))
        return F.aggregate(part, first, lambda acc, x: F.struct(
            step(acc["state"], x).cast(state_type).alias("state"),
            F.concat(acc["out"], F.array(emit(acc["state"], x).cast(out_type))).alias("out")), lambda acc: acc["out"])

    return let(items, lambda x: let(cut(x), lambda pieces: F.flatten(F.zip_with(pieces, along(pieces), inside))))
