"""Filter documents (nested dicts) turned into columns that Catalyst can push down."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARISONS = {
    "$gte": lambda c, v: c >= v,
    "$lte": lambda c, v: c <= v,
    "$gt": lambda c, v: c > v,
    "$lt": lambda c, v: c < v,
    "$ne": lambda c, v: c != v,
    "$eq": lambda c, v: c == v,
    "$in": lambda c, v: c.isin(list(v)),
    "$contains": lambda c, v: F.array_contains(c, v),
}


OPERATORS = tuple(_COMPARISONS)


def matches(spec: Mapping[str, Any]) -> Column:
    """Condition for ``{"field": value}``, ``{"field": {"$op": value}}`` and ``{"$and": [...]}``.

    A dotted field reads a map or struct entry: ``metadata.category``.
    """
    parts: list[Column] = []
    for name, value in spec.items():
        if name == "$and":
            parts += [matches(s) for s in value]
        elif name == "$or":
            parts.append(reduce(lambda a, b: a | b, [matches(s) for s in value]))
        elif isinstance(value, Mapping):
            for operator, operand in value.items():
                if operator not in _COMPARISONS:
                    raise ValueError(f"unknown filter operator {operator}")
                parts.append(_COMPARISONS[operator](field_column(name), operand))
        else:
            parts.append(field_column(name) == F.lit(value))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def field_column(name: str) -> Column:
    """A column, or by a dotted name an entry of a map or struct column."""
    head, _, key = name.partition(".")
    return F.col(head)[key] if key else F.col(head)


def optional_equals(**conditions: Any) -> Column:
    """Conjunction of equalities, leaving out every argument that is falsy."""
    parts = [F.col(name) == F.lit(value) for name, value in conditions.items() if value]
    return reduce(lambda a, b: a & b, parts, F.lit(True))
